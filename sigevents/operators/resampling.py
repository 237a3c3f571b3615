"""How often each cluster is drawn when as many are drawn with replacement as there are.

Clusters have a rank, their place in the order of a hash. The counts of a draw are multinomial: of the n
clusters drawn, those of the first half of the ranks are a binomial number, of these those of its first
half another one, and so on down to runs of LEAF ranks at most, in which the clusters are drawn one by one.
The random numbers of a split or run are seeded by the seed, its ranks and the draws, so a task finds the
counts of the ranks it has by going down to them alone, and finds the same ones as any other task; a draw's
counts add up to n at any size. No table of draws times clusters is made, kept or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigevents.operators.metrics import prefix_sums

#: Draws whose counts are made at once.
DRAW_BLOCK = 200
#: Ranks whose clusters are drawn one by one.
LEAF = 256


def ranked(df: DataFrame, cluster: str, seed: int) -> tuple[DataFrame, int]:
    """cluster, rank of the distinct clusters, and how many there are; a missing cluster is one, too."""
    md5 = F.md5(F.concat_ws("|", F.coalesce(F.col(cluster).cast("string"), F.lit("")), F.col(cluster).isNull().cast("string"), F.lit(str(seed))))
    g = df.select(cluster).distinct().withColumns({"_h": F.conv(F.substring(md5, 1, 13), 16, 10).cast("double"), "_one": F.lit(1)})
    ranks = prefix_sums(g, "_h", ["_one"], descending=False).select(cluster, (F.col("cum__one") - 1).alias("rank"))
    return ranks, g.count()


def with_ranks(df: DataFrame, cluster: str, seed: int) -> tuple[DataFrame, int]:
    """``df`` with ``rank``, and the number of clusters."""
    ranks, n = ranked(df, cluster, seed)
    return df.join(ranks.withColumnRenamed(cluster, "_cluster"), F.col(cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster"), n


def rows_of_range(n: int) -> int:
    """Rows of a range of scores of ``n`` clusters: twice as many, so that making the counts costs less than using them, between bounds that a task can hold."""
    return min(max(10_000, 2 * n), 1_000_000)


def ranges_of(spark: SparkSession, rows: int, range_rows: int) -> int:
    """How many ranges: of ``range_rows`` at most, and some for every core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // range_rows))


def _random(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def block_counts(ranks: np.ndarray, n: int, first: int, seed: int) -> np.ndarray:
    """Counts (ranks, DRAW_BLOCK) of some ascending distinct ranks in the DRAW_BLOCK draws from ``first`` on, a multiple of DRAW_BLOCK.

    One byte each: that a cluster is drawn more than 255 times has a probability of less than 1e-500.
    """
    out = np.zeros((len(ranks), DRAW_BLOCK), np.uint8)
    nodes = [(0, n, 0, len(ranks), np.full(DRAW_BLOCK, n, np.int64))] if len(ranks) else []
    while nodes:
        lo, hi, a, b, counts = nodes.pop()
        random = _random(seed, first, lo, hi)
        if hi - lo <= LEAF:
            place = random.integers(0, hi - lo, counts.sum(), np.uint8).astype(np.int64)
            place *= DRAW_BLOCK
            place += np.arange(DRAW_BLOCK).repeat(counts)
            out[a:b] = np.bincount(place, minlength=(hi - lo) * DRAW_BLOCK).reshape(hi - lo, DRAW_BLOCK)[ranks[a:b] - lo]
            continue
        mid = (lo + hi) // 2
        left = random.binomial(counts, (mid - lo) / (hi - lo))
        cut = a + int(np.searchsorted(ranks[a:b], mid))
        if cut > a:
            nodes.append((lo, mid, a, cut, left))
        if b > cut:
            nodes.append((mid, hi, cut, b, counts - left))
    return out


def blocks(ranks: np.ndarray, n: int, draws: int, seed: int, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """First draw and counts (ranks, draws) of ascending distinct ranks, at most DRAW_BLOCK draws at a time."""
    for first in range(0, draws, DRAW_BLOCK):
        yield first, block_counts(ranks, n, start + first, seed)[:, : draws - first]


def drawn(ranks: np.ndarray, n: int, first: int, draws: int, seed: int) -> np.ndarray:
    """Counts (draws, ranks) of some ascending distinct ranks in the draws ``first`` ... of ``n`` clusters. ``first`` is a multiple of DRAW_BLOCK."""
    return np.concatenate([w.T for _, w in blocks(ranks, n, draws, seed, first)]).astype(np.int64)
