"""Near duplicates by MinHash with tensored banding.

A document's set is that of jaccard.py: its distinct shingles of ``width`` words (with fewer words, the
whole sequence as one). Two documents link when ``100 * intersection >= percent * union``, which is
confirmed on whole sets.

*Tables.* Of each set two small collections of ``bands`` values are made, each value of ``rows``
minhashes. A table's key is a pair of values, one of each collection: ``bands ** 2`` tables of
``2 * rows`` minhashes each come from ``2 * bands * rows`` minhashes, about the square root of what
tables of their own would take. Sets of similarity s share a key unless one of the collections has no
value in common, so a link is missed with probability ``2 * (1 - s ** rows) ** bands`` at most: 5e-7 at
0.85 with the 16 values of 3 here, and less for what is linked through others too.

*Keys.* Equal sets are one node. Values that one node alone has are dropped first, by an aggregate
joined back, and pairs are only formed of the others, so texts without a relative send 32 numbers and no
keys. Of buckets with the same nodes one stays. All are aggregates and joins by value, key or node,
whose large partitions Spark can split; no bucket is gathered in a row.

*Links.* A bucket's nodes are compared with its hub first, then those of different components with each
other where their sketches let them link (both as in jaccard.py), and components are stars.

Documents without words or text link with nothing. Repeated ids: each row is a document of its own
that shares the id; a component's name is its smallest id, null if it has none. A row is kept if its id
is the name, so of rows that repeat it all are. Texts of any length are whole sets. Other columns are not
looked at. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.llm import jaccard
from sigevents.llm.common import keyed, stored, tidied
from sigevents.llm.components import components
from sigevents.llm.jaccard import mix, node_of, shingles

WIDTH, PERCENT = 5, 85
#: Values of a collection, and minhashes of a value.
BANDS, ROWS = 16, 3


def multipliers(n: int) -> np.ndarray:
    """Odd numbers, one for each minhash."""
    return mix(np.arange(n, dtype=np.uint64), 41) | np.uint64(1)


def minhashes(s: np.ndarray, odd: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """The least product of an element with each odd number; elements are hashes already."""
    out = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for b in range(0, len(s), at_once):
        np.minimum(out, np.multiply.outer(odd, s[b : b + at_once]).min(1), out=out)
    return out


def value_pair(s: np.ndarray, odd: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The values of both collections of a set, two rows of ``bands``; a value tells its collection and place."""
    least = mix(minhashes(s, odd)).reshape(2 * bands, rows)
    value = np.arange(2 * bands, dtype=np.uint64)
    for r in range(rows):
        value = mix(value ^ least[:, r], 43 + r)
    return value.reshape(2, bands).view(np.int64)


def hashed_rows(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """_row, n_shingles, node of each row, and the collections a, b where a task meets the node first. ``docs``: _row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, seen = multipliers(2 * bands * rows), set()
        for batch in batches:
            sizes, nodes, pairs = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, width)
                node = node_of(s) if len(s) else None
                new = node is not None and node not in seen
                if new:
                    seen.add(node)
                sizes.append(len(s))
                nodes.append(node)
                pairs.append(value_pair(s, odd, bands, rows).tolist() if new else (None, None))
            if len(seen) > 500_000:
                seen.clear()
            lists = [pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *lists], names=["_row", "n_shingles", "node", "a", "b"])

    return docs.select("_row", "text").mapInArrow(tidied(run), "_row long, n_shingles long, node long, a array<long>, b array<long>")


def bucket_rows(hashed: DataFrame) -> DataFrame:
    """run, n, node, size: a row for each node of each bucket of ``n`` > 1 nodes, of buckets with equal nodes one."""
    nodes = hashed.where("a is not null").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("a").alias("a"), F.first("b").alias("b"))
    values = nodes.select("node", "size", F.explode(F.concat(F.transform("a", lambda x: F.struct(F.lit(True).alias("first"), x.alias("value"))), F.transform("b", lambda x: F.struct(F.lit(False).alias("first"), x.alias("value"))))).alias("v")).select("node", "size", "v.first", "v.value")
    values = stored(values, "values")
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    some = values.join(shared, "value").groupBy("node").agg(F.first("size").alias("size"), F.collect_list(F.when(F.col("first"), F.col("value"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("value"))).alias("b"))  # a collection's size at most
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keys = stored(some.select("node", "size", F.explode(pairs).alias("key")), "keys")
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    one = met.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return keys.join(one, "key").select(F.col("key").alias("run"), "n", "node", "size")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    docs = keyed(docs, "doc_id", "text")
    ids = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"))
    docs = docs.select("_row", F.col("text").cast("string").alias("text"))
    hashed = stored(hashed_rows(docs, width, bands, rows), "hashed")
    flat = stored(bucket_rows(hashed), "buckets")
    sets = stored(hashed.select("_row", "n_shingles", "node").join(ids, "_row"), "sets")
    names = stored(sets.where("node is not null").groupBy("node").agg(F.min("_row").alias("doc_id"), F.min("doc_id").alias("least")), "names")
    texts = docs.withColumnRenamed("_row", "doc_id")
    links = stored(jaccard.verify(texts, names, jaccard.star_pairs(flat, percent), width, percent), "links")
    labels = stored(components(links), "labels")
    more = stored(jaccard.verify(texts, names, jaccard.rest_pairs(texts, names, flat, labels, width, percent), width, percent), "links")
    if more.limit(1).count():
        labels = stored(components(links.union(more)), "labels")
    labelled = labels.join(names, "node").select("node", "least", "component")
    named = labelled.join(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    alone = names.join(labels, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    full = sets.where("node is not null").join(named.union(alone), "node").select("doc_id", "n_shingles", "component_id")
    out = full.union(sets.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same rows as near_duplicates(documents).
ORACLE_SQL = jaccard.ORACLE_SQL.replace("100 * c >= 80 *", "100 * c >= 85 *").replace("m.component_id\nFROM", "m.component_id, d.doc_id = m.component_id AS kept\nFROM")
