"""Main text of web pages: differencing with the page of the nearest URL, then the page's structure.

Pages are sorted by host and path (range partitions, so that a host with very many pages is split),
and each is paired with the neighbour, on the same host, whose path shares the longer beginning; ties
take the one before. The first and last page of each partition are also sent to the neighbouring one,
so pairs do not depend on partitions; only a page alone on its host has none. Both pages' text lines
are aligned by longest common subsequence, and lines of the page that are shared are template and
are deleted, unless they stand in an article or main element, where shared lines are copied content.

Differencing cannot see what varies from page to page, such as advertisements drawn at random. So,
after it, lines of elements that never hold main text (menus, headers, footers, sidebars, forms,
scripts, notices, adverts, comments: by tag, role, class or id; class or id of what stands around an
article or main element does not count for it) go too, and when a page has an
article or main element, only lines in it stay.

A page whose lines are all shared is a copy of its pair: then nothing is deleted as shared. Null and
empty pages give an empty text. White space, entities and blocks are handled as a reader sees them; a
line break is white space of its block. Repeated rows each give a row with the same text; pages of one
url are in order of their ids, null ones first. Ids and urls may be null. Pages of any length are read
whole, in time that grows with them (times the pair's lines, a bit each, where lines are shared).
Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import tidied
from sigevents.llm.url_filter import host_of, path_of

# A tag without end, or with an open quote, runs to the end of the page, as browsers have it.
_ATTRS = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'].*\Z)*+(?:>|\Z)"
_part = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|select|textarea|title)\b{_ATTRS}.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRS})", re.S | re.I)
_hint = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_word = re.compile(r"[a-z0-9]+")
# Elements that end a line, and those that hold no main text.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NESTED = set("article aside button dialog div fieldset footer form head header main menu nav ol section table ul".split())
BESIDE = set("aside button dialog fieldset footer form head header menu nav".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BESIDE_WORDS = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent dialog disqus footer form masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """Text lines in page order: text, whether it stands in an article, whether beside the main text."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, in an article, beside by tag, beside by a hint
    opened: Counter[str] = Counter()  # how often each tag is in the stack
    held: list[str] = []

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def top() -> tuple[str, bool, bool, bool]:
        return stack[-1] if stack else ("", False, False, False)

    def end_line() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, article, beside, hinted = top()
            out.append((text, article, beside or hinted))

    def inline_ad() -> bool:
        """Whether what comes is in an element that is hidden within its line."""
        return bool(stack) and stack[-1][0] not in BLOCKS

    at, page = 0, page or ""
    for m in _part.finditer(page):
        if not inline_ad():
            held.append(page[at : m.start()])
        at = m.end()
        tag, attrs = (m[3] or "").lower(), m[4] or ""
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
        block = tag in BLOCKS
        if block:
            end_line()
            while stack and (stack[-1][0] == "p" or inline_ad()):  # a paragraph, and what is open in it, ends where a block begins or ends
                close()
                if m[2] and tag == "p":
                    break
        if m[2]:
            while opened[tag]:
                if close() == tag:
                    break
            continue
        if tag in VOID or attrs.rstrip(">").endswith("/"):
            continue
        _, article, beside, hinted = top()
        own = tag in ("article", "main")
        hint = not own and tag not in ("html", "body") and bool(attrs) and any(w in BESIDE_WORDS for h in _hint.findall(attrs) for w in _word.findall(h.lower()))
        if tag in NESTED or hint:
            hinted = hinted and not (own and not article)  # what stands around the outermost article says nothing of it
            stack.append((tag, article or own, beside or tag in BESIDE, hinted or hint))
            opened[tag] += 1
    if not inline_ad():
        held.append(page[at:])
    end_line()
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each beginning of ``a`` with ``b``; a row of bits, one for each line of ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:  # a zero bit stands where the subsequence grows
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by halves of ``b``, so that memory grows with the lines and not with their product."""
    shared: set[int] = set()
    work = [(list(range(len(a))), b)]
    while work:
        at, b = work.pop()
        known = set(b)
        at = [i for i in at if a[i] in known]
        if not at:
            continue
        known = {a[i] for i in at}
        b = [x for x in b if x in known]
        if len(b) == 1:
            shared.add(at[0])
            continue
        half = len(b) // 2
        of = [a[i] for i in at]
        cut = int((_lengths(of, b[:half]) + _lengths(of[::-1], b[half:][::-1])[::-1]).argmax())
        work += [(at[:cut], b[:half]), (at[cut:], b[half:])]
    return shared


def main_text(lines: list[tuple[str, bool, bool]], pair: list[tuple[str, bool, bool]] | None) -> str:
    shared = common_lines([x[0] for x in lines], [x[0] for x in pair]) if pair else set()
    if len(shared) == len(lines):  # a copy of its pair tells nothing of either
        shared = set()
    kept = [x for i, x in enumerate(lines) if not x[2] and (x[1] or i not in shared)]
    inside = [x for x in kept if x[1]]
    return "\n\n".join(x[0] for x in (inside or kept))


#: Keys a partition that are drawn to find even bounds; they have no effect on the result.
DRAWN = 20


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``part``, ranges of ``KEY``, and ``guest``: copies of the pages at the edges of the parts beside.

    Bounds, and the edges' keys, are a few for each partition; they pass through the driver.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted(tuple(r) for r in rows.select(*KEY[:3]).orderBy(F.xxhash64(*KEY[:3])).limit(DRAWN * n).collect())
    bounds = sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if drawn else []
    part = F.lit(0)
    if bounds:
        named = lambda *c: F.struct(*(x.alias(k) for x, k in zip(c, KEY, strict=False)))
        part = F.size(F.filter(F.array(*(named(F.lit(h), F.lit(p), F.lit(i).cast("long")) for h, p, i in bounds)), lambda b: b <= named(*map(F.col, KEY[:3]))))
    rows = rows.withColumn("part", part).withColumn("guest", F.lit(False))
    key = F.struct(*KEY)
    edges = sorted(rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect(), key=lambda r: r.part)
    sent = [x for a, b in zip(edges, edges[1:], strict=False) if a.last.host == b.first.host for x in ((*a.last, b.part), (*b.first, a.part))]
    if not sent:
        return rows
    sent = spark.createDataFrame(sent, "host string, path string, place long, sum long, to int")
    guests = rows.join(F.broadcast(sent), KEY).dropDuplicates([*KEY, "to"]).withColumn("part", F.col("to")).withColumn("guest", F.lit(True))
    return rows.union(guests.select(*rows.columns))


#: The order of pages; ``place`` is the id, ``sum`` a checksum of the page.
KEY = ["host", "path", "place", "sum"]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # three pages in a row are held: the one before, the one to be done, the one after
        before = now = None

        def finish(after: tuple | None) -> tuple:
            pair, near = None, -1
            for other in (before, after):
                if other and other[2] == now[2] and (n := len(commonprefix([other[3], now[3]]))) > near:
                    pair, near = other[4], n
            return now[0], now[1], main_text(now[4], pair)

        def out(done: list[tuple]) -> pa.RecordBatch:
            page_id, url, text = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(page_id, pa.int64()), pa.array(url, pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        for batch in batches:
            done: list[tuple] = []
            for page_id, url, page, host, path, part, guest in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "path", "part", "guest")), strict=True):
                after = (page_id, url, host, path, lines_of(page), part, guest)
                same = now and now[5] == part
                if now and not now[6]:
                    done.append(finish(after if same else None))
                before, now = now if same else None, after
            if done:
                yield out(done)
        if now and not now[6]:
            yield out([finish(None)])

    keys = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("place"), F.xxhash64("html").alias("sum"))
    ordered = dealt(keys).repartitionByRange("part").sortWithinPartitions("part", *KEY)
    return ordered.select("page_id", "url", "html", "host", "path", "part", "guest").mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
