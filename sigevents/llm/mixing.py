"""Mixing sources to target weights: hierarchical budgets and token prefixes of seeded epochs.

The tree is domain, language, source. A token budget is handed down from the root: at each node the
children share the node's budget by their weights, none gets more than its supply (its tokens times
``max_epochs``), and what a short child leaves goes to its siblings by weight. As no node is handed
more than its supply, a shortage leaves a node only when all its siblings below are full: siblings
are served before ancestors.

A leaf's share is whole epochs of its documents and a prefix of one more. Each epoch has its own
order, by MD5 of seed, epoch and document id; the prefix is the shortest that reaches the share.
To find where it ends, tokens are summed by the first ``BIN`` hex digits of that hash, then in the bin
in which it ends by the next ``BIN``; only the second bin in which it ends, a part in sixteen million of
a leaf, is summed row by row. A leaf with a third of all rows is thus never gathered.

DataFrame operations only. Null and empty texts have no tokens. An empty table gives an empty table;
texts of any length count whole; other columns are passed on or not looked at. Null domain, language or source are a value of
their own (an empty name). Rows with the same id share their place in the order. Children without a
weight have ``default``; weights of zero or less get nothing unless no sibling can take the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.llm.common import stored

LEVELS = ("domain", "lang", "source")
#: Weights among siblings, by name; production parameters of the query.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {}}
BIN = 3


def domain_of(source: Column) -> Column:
    """A source's domain: its number modulo 4, as in the documents' source names; else `other`."""
    number = F.regexp_extract(source, r"([0-9]+)", 1).try_cast("bigint")
    return F.coalesce(F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), F.lit("other"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]], default: float) -> Column:
    known = weights.get(level, {})
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], F.lit(float(kv[1]))), known.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(float(default)))


def _share_out(nodes: DataFrame, parents: list[str], level: str, weights: dict, default: float) -> DataFrame:
    """Hand each parent's ``budget`` to its children with ``supply``; returns children with ``share``."""
    every = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    filling = every.orderBy("fills", level).rowsBetween(Window.unboundedPreceding, 0)
    w = nodes.withColumn("w", F.greatest(_weight(level, weights, default), F.lit(1e-12))).withColumn("fills", F.col("supply") / F.col("w"))
    # what all children hold when this one is just full
    w = w.withColumn("level", F.sum("supply").over(filling) + F.col("fills") * (F.sum("w").over(every) - F.sum("w").over(filling)))
    w = w.withColumn("full", F.col("level") <= F.col("budget"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("supply")).otherwise(F.lit(0.0))).over(every)
    open_w = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(every)
    return w.withColumn("share", F.when(F.col("full"), F.col("supply")).otherwise(F.least("supply", F.col("w") * left / open_w))).drop("w", "fills", "level", "full")


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: dict, default: float) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``share``, the tokens each is to give."""
    supply = leaves.withColumn("supply", F.col("tokens").cast("double") * max_epochs)
    domains = supply.groupBy("domain").agg(F.sum("supply").alias("supply"))
    total = leaves.agg(F.floor(F.sum("tokens") * budget_share).cast("double").alias("budget"))
    domains = _share_out(domains.join(F.broadcast(total)), [], "domain", weights, default)  # one row
    langs = supply.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = _share_out(langs, ["domain"], "lang", weights, default)
    sources = supply.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return _share_out(sources, ["domain", "lang"], "source", weights, default).select(*LEVELS, "tokens", F.floor(F.round("share", 3)).cast("long").alias("share"))


def order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mixture_plan(rows: DataFrame, seed: str = "mix", budget_share: float = 0.8, max_epochs: int = 3, weights: dict | None = None, default: float = 1.0) -> DataFrame:
    """For each leaf: whole epochs, and the last key of the next epoch's prefix (null: no prefix).

    ``rows``: doc_id, domain, lang, source, n_tokens.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    shares = budgets(leaves, budget_share, max_epochs, WEIGHTS if weights is None else weights, default)
    epochs = stored(shares.select(*LEVELS, "share", F.expr("share div tokens").alias("epochs"), F.expr("share % tokens").alias("rest")), "shares")
    keyed = rows.join(epochs.where("rest > 0"), list(LEVELS)).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    cut = None
    for depth in (BIN, 2 * BIN):
        inside = keyed.withColumn("bin", F.substring("key", 1, depth))
        inside = inside.withColumn("base", F.lit(0).cast("long")) if cut is None else inside.withColumn("above", F.substring("key", 1, depth - BIN)).join(cut.select(*LEVELS, F.col("bin").alias("above"), F.col("before").alias("base")), [*LEVELS, "above"])
        bins = inside.groupBy(*LEVELS, "bin", "rest", "base").agg(F.sum("n_tokens").alias("n"))
        before = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        cut = stored(bins.where("before < rest and before + n >= rest").select(*LEVELS, "bin", "before"), "cuts")
    keyed = keyed.withColumn("bin", F.substring("key", 1, 2 * BIN))
    by_key = keyed.join(cut, [*LEVELS, "bin"]).groupBy(*LEVELS, "key", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = by_key.withColumn("sum", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("sum < rest").groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    return stored(epochs.select(*LEVELS, "share", "epochs").join(last, list(LEVELS), "left"), "plan")


def leaf_columns(docs: DataFrame) -> DataFrame:
    """doc_id and its leaf: domain, lang, source, n_tokens."""
    return docs.select(F.col("doc_id"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens_of(F.col("text")).alias("n_tokens"))


def take(rows: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (with doc_id and the leaf's columns) once for each epoch that takes them: column ``epoch``."""
    found = rows.join(plan, list(LEVELS))
    extra = (order_key(seed, F.col("epochs"), F.col("doc_id")) <= F.col("last_key")).cast("int")
    copies = F.col("epochs").cast("int") + F.coalesce(extra, F.lit(0))
    return found.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("epochs", "last_key", "share", "copies")


def mixture_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each time that a document is taken."""
    rows = stored(leaf_columns(docs), "leaves")
    return take(rows, mixture_plan(rows, **how)).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents taken, with all columns of ``docs``, whatever their names; one row for each time."""
    rows = stored(leaf_columns(docs), "leaves")
    own = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return take(own, mixture_plan(rows, **how), how.get("seed", "mix")).select("whole.*")


def _sql(seed: str = "mix", budget_share: float = 0.8, max_epochs: int = 3) -> str:
    """The same rows as mixture_table(documents)."""

    def weight(level: str) -> str:
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v!r}" for k, v in WEIGHTS[level].items()) + " ELSE 1.0 END" if WEIGHTS[level] else "1.0"

    def share(table: str, parents: str, level: str) -> str:
        part = f"PARTITION BY {parents}" if parents else ""
        return f"""
  SELECT *, CASE WHEN filled THEN supply ELSE least(supply, w * (budget - sum(CASE WHEN filled THEN supply ELSE 0.0 END) OVER ({part})) / sum(CASE WHEN filled THEN 0.0 ELSE w END) OVER ({part})) END AS share FROM (
    SELECT *, sum(supply) OVER o + supply / w * (sum(w) OVER ({part}) - sum(w) OVER o) <= budget AS filled
    FROM (SELECT *, CAST({weight(level)} AS DOUBLE) AS w FROM {table}) WINDOW o AS ({part} ORDER BY supply / w, {level} ROWS UNBOUNDED PRECEDING))"""

    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 4 AS VARCHAR), 'other') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {max_epochs} AS supply FROM rows_ GROUP BY domain, lang, source HAVING sum(n_tokens) > 0),
d AS (SELECT domain, sum(supply) AS supply, (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {budget_share}) FROM leaves) AS budget FROM leaves GROUP BY domain),
d2 AS ({share("d", "", "domain")}),
l AS (SELECT x.domain, lang, sum(x.supply) AS supply, any_value(d2.share) AS budget FROM leaves x JOIN d2 USING (domain) GROUP BY x.domain, lang),
l2 AS ({share("l", "domain", "lang")}),
s AS (SELECT x.*, l2.share AS budget FROM leaves x JOIN l2 USING (domain, lang)),
s2 AS ({share("s", "domain, lang", "source")}),
e AS (SELECT domain, lang, source, CAST(floor(round(share, 3)) AS BIGINT) // tokens AS epochs, CAST(floor(round(share, 3)) AS BIGINT) % tokens AS rest FROM s2),
k AS (SELECT rows_.*, epochs, rest, md5(concat_ws(':', '{seed}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM rows_ JOIN e USING (domain, lang, source)),
c AS (SELECT domain, lang, source, key, coalesce(sum(sum(n_tokens)) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k GROUP BY domain, lang, source, key),
t AS (SELECT k.*, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS copies FROM k JOIN c USING (domain, lang, source, key))
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, copies)) AS INTEGER) AS epoch FROM t WHERE copies > 0
"""


ORACLE_SQL = _sql()
