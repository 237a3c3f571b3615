"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ``window`` consecutive words (an item of fewer words is one
window). Words are ordered by rarity, their number of documents over the whole corpus. A document
that holds a window holds its rarest word: containment must be whole, so the prefix to be joined
has one token. Joined positions are kept if the window fits between the document's ends (length and
positional bounds) and then compared word for word.

The benchmark is broadcast in blocks of about ``block_windows`` windows, as the items' words and flat
arrays of places in them, so that what a task holds is bounded (some 150 bytes a window) whatever its
size; a benchmark of more blocks takes more passes over the documents, and what they find is joined
by a key of each document row.

Null or empty texts, of documents or items, have no words: nothing is hit, nothing occurs. Items
without an id are left out; repeated items count once by their id, of any type. Repeated document rows
each give a row with the same result; ids may be null. Equal rarities are decided by the words, which
changes no result. Texts of any length are searched whole. Other columns are not looked at. An empty
table of documents gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import keyed, lower_ascii, tidied

#: Digits, a-z and everything beyond ASCII.
find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def item_words(text: str | None) -> list[str]:
    return find(lower_ascii(text)) if text else []


def windows_of(words: list[str], window: int) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def rarity(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Number of documents of each word of a benchmark block, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(shared.value.intersection(find(lower_ascii(text))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return {r.word: r.n for r in docs.select("text").mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Windows of a benchmark block by their rarest word.

    Of equal windows one is kept, with all items that have it. ``windows``: rarest word -> windows;
    ``start``, ``size``, ``at``: a window's words in ``words`` and the rarest one's place in it;
    ``owners[first[w]:first[w + 1]]``: the items that have window ``w``.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int, df: dict[str, int]):
        known: dict[str, str] = {}
        self.words: list[str] = []
        self.names = sorted({item_id for item_id, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        start, size, owner, digests = array("q"), array("i"), array("i"), bytearray()
        for item_id, words in items:
            begin, n = len(self.words), min(window, len(words))
            self.words.extend(known.setdefault(w, w) for w in words)
            for i in range(len(words) - n + 1):
                start.append(begin + i)
                size.append(n)
                owner.append(number[item_id])
                digests += hashlib.blake2b(" ".join(words[i : i + n]).encode(), digest_size=16).digest()
        key = np.frombuffer(bytes(digests), np.uint64).reshape(-1, 2)
        who = np.array(owner, np.int32)
        order = np.lexsort((who, key[:, 1], key[:, 0]))
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        other = new.copy()
        other[1:] |= who[1:] != who[:-1]  # an item counts once for each window
        self.owners = who[other]
        self.first = np.append(np.flatnonzero(new[other]), len(self.owners))
        self.start, self.size = np.array(start, np.int64)[order][new], np.array(size, np.int32)[order][new]
        self.at = np.zeros(len(self.start), np.int32)
        by_word: dict[str, array] = defaultdict(lambda: array("i"))
        for k, (b, n) in enumerate(zip(self.start.tolist(), self.size.tolist(), strict=True)):
            w = self.words[b : b + n]
            self.at[k] = at = min(range(n), key=lambda i: (df.get(w[i], 0), w[i], i))
            by_word[w[at]].append(k)
        self.windows = dict(by_word)


def find_hits(words: list[str], index: Index) -> tuple[bytearray, set[str]]:
    """Which words stand inside an occurrence of a window, and the items whose windows occur."""
    hit, found, n = bytearray(len(words)), set(), len(words)
    windows = index.windows
    for i in [i for i, w in enumerate(words) if w in windows]:
        for k in windows[words[i]]:
            size = int(index.size[k])
            begin = i - int(index.at[k])
            if begin < 0 or begin + size > n:
                continue
            start = int(index.start[k])
            if words[begin : begin + size] == index.words[start : start + size]:
                hit[begin : begin + size] = b"\1" * size
                found.add(k)
    return hit, {index.names[x] for k in found for x in index.owners[index.first[k] : index.first[k + 1]]}


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple]]:
    """The benchmark's items, block by block, through an iterator that fetches a partition at a time."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").toLocalIterator():
        if words := item_words(r.text):
            block.append((r.item_id, words))
            n += max(1, len(words) - window + 1)
            if n >= block_windows:
                yield block
                block, n = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 500_000) -> DataFrame:
    """doc_id, n_words, spans of hit words, items that occur, n_hit; one row for each row of ``docs``."""
    return row_hits(keyed(docs, "doc_id", "text"), benchmark, window, block_windows).drop("_row")


def row_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 500_000) -> DataFrame:
    """The same for keyed documents, with their key."""
    docs = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, out, n_blocks = docs.sparkSession, None, 0
    for block in _blocks(benchmark, window, block_windows):
        if not block and n_blocks:
            break
        df = rarity(docs, {w for _, words in block for w in words}) if block else {}
        index = spark.sparkContext.broadcast(Index(block, window, df))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = [], [], []
                for text in batch.column("text").to_pylist():
                    words = item_words(text)
                    hit, found = find_hits(words, index.value)
                    n_words.append(len(words))
                    spans.append([x for m in re.finditer(b"\1+", hit) for x in m.span()] if found else [])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["_row", "doc_id", "n_words", "spans", "items"])

        found = docs.mapInArrow(tidied(search), "_row long, doc_id long, n_words long, spans array<int>, items array<string>")
        if n_blocks:  # another block's hits join the first one's, by row
            more = found.where(F.size("spans") > 0).select("_row", F.col("spans").alias("s2"), F.col("items").alias("i2"))
            none = F.array().cast("array<int>")
            out = out.join(more, "_row", "left").select("_row", "doc_id", "n_words", F.concat("spans", F.coalesce("s2", none)).alias("spans"), F.array_distinct(F.concat("items", F.coalesce("i2", none.cast("array<string>")))).alias("items"))
        else:
            out = found
        n_blocks += 1
    if n_blocks < 2:
        return out.withColumn("n_hit", F.aggregate(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int")), F.lit(0).cast("long"), lambda a, k: a + F.coalesce(F.get("spans", 2 * k + 1) - F.get("spans", 2 * k), F.lit(0))))
    inside = F.array_distinct(F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda k: k % 2 == 0), lambda k: F.sequence(F.get("spans", k), F.get("spans", k + 1) - 1))))
    return out.withColumn("n_hit", F.when(F.size("spans") > 0, F.size(inside)).otherwise(0).cast("long"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest of :func:`contamination`."""
    names = F.array_join(F.array_sort("items"), ",")
    return contamination(docs, benchmark, window).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same rows as contamination_report(documents, benchmark).
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), keys AS (SELECT DISTINCT n, g FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), occ AS (SELECT doc_id, i, n, g FROM grams JOIN keys USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM (SELECT DISTINCT doc_id, n, g FROM occ) JOIN win USING (n, g)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
