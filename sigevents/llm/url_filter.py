"""URL filtering: rules first, then a classifier over words segmented out of host and path.

Concatenated host names are split by a unigram Viterbi search; word counts come from all paths and
hyphenated host names of the corpus and from the lists of known words below. A word of paths and names
has 2 to 20 letters and is there twice at least; anything else in a name is split like unknown letters.
Segmented host and path tokens are scored by multinomial naive Bayes. It learns from all pages that a
rule decides, by the rule's verdict. The words that rules are made of (of their hosts, and their paths')
are no tokens: they would only say again which rule a page is like. A token counts once for each host
and verdict, however many pages the host has, and the classes have equal weight before a token is seen:
how many pages the rules happen to decide either way says nothing about the others. Unwanted words are
known before any page: each counts as if it had been in ``SEED`` blocked hosts, which what the pages say
can outweigh; the classes' totals are of what was seen alone, so this says nothing about other words. The classifier decides the pages that no rule does.

A null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Ties
between the classes allow. Without pages under rules only the known words count. Repeated rows each
give a row with the same verdict and count each; a null id is no reason to leave a row out. Urls of
any length are read whole; words of more than 20 letters are split like unknown ones. Other columns
are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import stored

#: (verdict, host, path): the longest rule that fits decides.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Words of unwanted hosts, and words that hosts are often made of.
UNWANTED = "ads adult bet bets betting bonus casino cheap click clicks crack deals drugs escort farm free gamble gambling hack jackpot keygen loan loans lottery pharma pharmacy pills poker porn promo prize seo sex slots spam survey torrent track tracker tracking viagra warez win winner xxx".split()
USUAL = "about api app art blog book books city cloud code com data dev docs edu example forum game games group help home host info lab library mail map media mobile music net new news online org page pages park photo post press science school shop site store study team tech time travel university video web weather wiki world www".split()

#: Blocked hosts that each unwanted word counts for before any page is seen.
SEED = 20
_letters = re.compile(r"[a-z]+")


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (host and path) that decides, and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    return tuple(reduce(lambda c, x: c.when(x[0], F.lit(x[1])), zip(fits, values, strict=True), F.when(F.lit(False), F.lit(None).cast("string"))) for values in ([h + p for _, h, p in ordered], [v for v, _, _ in ordered]))


def rule_words(rules=RULES) -> frozenset[str]:
    """Tokens of the rules' own hosts and paths."""
    return frozenset(w for _, host, path in rules for w in (*runs_of(host), *(f"/{x}" for x in _letters.findall(path.lower()))))


def word_costs(pages: DataFrame, max_words: int = 50_000) -> tuple[dict[str, float], float, float, DataFrame | None]:
    """Minus log probabilities of words: of the ``max_words`` most frequent of the corpus and the lists; the largest one of all words,
    the logarithm of all words' number, and a table (w, n) of the words beyond ``max_words``, if there are any. All words count that are seen twice.
    """
    parts = F.array_union(F.split(F.lower("path"), "[^a-z]+"), F.when(F.col("host").contains("-"), F.split("host", "[^a-z]+")).otherwise(F.array().cast("array<string>")))
    counted = pages.select(F.explode(parts).alias("w")).where(F.length("w").between(2, 20)).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    counted = stored(counted, "words")
    lists = sorted({*UNWANTED, *USUAL})
    size, total, least = counted.agg(F.count("*"), F.sum("n"), F.min("n")).first()
    top = counted.orderBy(F.desc("n"), "w").limit(max_words).collect()
    counts = {r.w: r.n for r in top}
    floor = max(10, (total or 0) // 1000)
    listed = {r.w: r.n for r in counted.where(F.col("w").isin(lists)).collect()}
    for w in lists:
        counts[w] = max(listed.get(w, 0), floor)
    total = (total or 0) + sum(counts[w] - listed.get(w, 0) for w in lists)
    rare = None
    if size > len(top):
        rare = counted.where(~F.col("w").isin(lists))
        if top:
            rare = rare.where((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("w") > top[-1].w)))
    lowest = min([*counts.values(), *([least] if rare is not None else [])])
    return {w: math.log(total / n) for w, n in counts.items()}, math.log(total / lowest), math.log(total), rare


def segment(name: str, costs: dict[str, float], unknown: float | None = None, rare: dict[str, float] | None = None) -> list[str]:
    """The likeliest split of a run of letters. A stretch that is no word costs more for each letter.

    ``unknown``: the largest cost; ``rare``: costs of more words.
    """
    unknown = max(costs.values(), default=1.0) if unknown is None else unknown
    costs = ChainMap(rare, costs) if rare else costs
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        best.append(min((best[b][0] + costs.get(name[b:end], unknown + 3.0 * (end - b)), b) for b in range(max(0, end - 20), end)))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def runs_of(host: str) -> list[str]:
    """Runs of letters of a host without its last label."""
    return _letters.findall(host.rpartition(".")[0])


def tokens(host: str, path: str, model: dict, cache: dict[str, list[str]], rare: list[dict] | None = None) -> tuple[list[str], list[str]]:
    """Words of a host (without its last label) and of a path, without those of rules. ``rare``: words beyond the model's that stand in the host, and their counts."""
    if host not in cache:
        if len(cache) > 100_000:
            cache.clear()
        more = {r["w"]: model["log_total"] - math.log(r["n"]) for r in rare or ()}
        cache[host] = [w for part in runs_of(host) if part not in model["dropped"] for w in segment(part, model["costs"], model["unknown"], more)]
    return cache[host], [f"/{w}" for w in _letters.findall(path.lower()) if f"/{w}" not in model["dropped"]]


def with_rare_words(pages: DataFrame, rare: DataFrame | None, costs: dict[str, float]) -> DataFrame:
    """``pages`` with the rare words (w, n) that stand in each row's host; found by joining the stretches of each distinct host."""
    if rare is None:
        return pages.withColumn("rare", F.lit(None).cast("array<struct<w:string,n:long>>"))
    shared = pages.sparkSession.sparkContext.broadcast(set(costs))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host in batch.column("host").to_pylist():
                found = {run[b:e] for run in runs_of(host) for b in range(len(run)) for e in range(b + 2, min(len(run), b + 20) + 1)} - shared.value
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(sorted(found), pa.string())], names=["host", "w"])

    found = pages.select("host").distinct().mapInArrow(stretches, "host string, w string").join(rare, "w").groupBy("host").agg(F.collect_list(F.struct("w", "n")).alias("rare"))
    return pages.join(found, "host", "left").select(*pages.columns, "rare")


def learn(pages: DataFrame, rules=RULES, max_tokens: int = 50_000, max_words: int = 50_000) -> tuple[dict, DataFrame, DataFrame | None]:
    """Word costs and the classifier's odds; the pages with their rare words; and (token, odds) of the tokens beyond ``max_tokens``, if any.

    Totals and the size of the vocabulary are of all tokens.
    """
    costs, unknown, log_total, rare = word_costs(pages, max_words)
    pages = with_rare_words(pages, rare, costs)
    model = {"costs": costs, "unknown": unknown, "log_total": log_total, "dropped": rule_words(rules)}
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = {}, set()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen, strict=True), (pa.bool_(), pa.string(), pa.string()), strict=True)], names=["bad", "host", "w"])

        for batch in batches:
            for host, path, rare, bad in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rare", "bad")), strict=True):
                own, rest = tokens(host, path, shared.value, cache, rare)
                seen.update((bad, host, w) for w in (*own, *rest))
            if len(seen) > 200_000:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    verdict = rule_of(F.col("host"), F.col("path"), rules)[1]
    rows = pages.select("host", "path", "rare", (verdict == "block").alias("bad")).where("bad is not null").mapInArrow(count, "bad boolean, host string, w string").distinct()
    rows = rows.groupBy("w").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    seeds = pages.sparkSession.createDataFrame([(w,) for w in UNWANTED], "w string").select("w", F.lit(SEED).alias("seed"))
    rows = stored(rows.join(seeds, "w", "full").select("w", (F.coalesce("bad", F.lit(0)) + F.coalesce("seed", F.lit(0))).alias("bad"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("seen")), "tokens")
    good, bad, size = rows.agg(F.sum("good"), F.sum("seen"), F.count("*")).first()
    below = [1 + (bad or 0) + size + 1, 1 + (good or 0) + size + 1]
    log_odds = lambda r: math.log((r.bad + 1) / below[0]) - math.log((r.good + 1) / below[1])
    top = rows.orderBy(F.desc(F.col("bad") + F.col("good")), "w").limit(max_tokens).collect()
    odds = {r.w: log_odds(r) for r in [*top, *rows.where(F.col("w").isin(UNWANTED)).collect()]}
    beyond = None
    if size > len(top):
        n = F.col("bad") + F.col("good")
        beyond = rows.where(~F.col("w").isin(UNWANTED))
        if top:
            last = top[-1].bad + top[-1].good
            beyond = beyond.where((n < last) | ((n == last) & (F.col("w") > top[-1].w)))
        beyond = beyond.select("w", (F.log((F.col("bad") + 1) / below[0]) - F.log((F.col("good") + 1) / below[1])).alias("odds"))
    return model | {"odds": odds}, pages, beyond


def judge(pages: DataFrame, rules=RULES, max_tokens: int = 50_000, max_words: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of `block`) of each row of ``pages``.

    Tokens that are not broadcast are joined by shuffle; the frequent ones are out of it.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    model, urls, beyond = learn(urls, rules, max_tokens, max_words)
    shared, joined = pages.sparkSession.sparkContext.broadcast(model), beyond is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, row = shared.value, {}, TaskContext.get().partitionId() << 36
        for batch in batches:
            score, more = [], []
            for host, path, rare in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rare")), strict=True):
                own, rest = tokens(host, path, model, cache, rare)
                score.append(sum(model["odds"].get(w, 0.0) for w in (*own, *rest)) if host else -1.0)
                more.append([w for w in (*own, *rest) if w not in model["odds"]] if host and joined else [])
            n = len(score)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), *(batch.column(c) for c in ("page_id", "host", "path")), pa.array(score, pa.float64()), pa.array(more, pa.list_(pa.string()))], names=["row", "page_id", "host", "path", "score", "more"])
            row += n

    scored = urls.mapInArrow(run, "row long, page_id long, host string, path string, score double, more array<string>")
    if joined:
        scored = stored(scored, "scores")
        rest = scored.select("row", F.explode("more").alias("w")).join(beyond, "w").groupBy("row").agg(F.sum("odds").alias("odds"))
        scored = scored.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("odds", F.lit(0.0)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
