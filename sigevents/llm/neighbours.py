"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Rows are dealt over shards by their length, in bands of a factor of two, and by a hash of their vector.
A shard's graph has layers; each node's top layer is drawn at random, and a layer links the nodes that
reach it. A layer is built in batches: each batch is searched in the graph so far, entered from the
layer above, and linked to diverse near nodes both ways. Largest inner product becomes smallest
distance by one more component that brings all vectors of a shard to one length; as a shard's lengths
are within a factor of two, no long vector hides the others' differences. Indexes are rows of flat
arrays, written to the shared folder. Every query is searched in every shard; results are scored
exactly, in double precision on the original vectors, and merged.

Equal vectors are one node with its smallest ids, as many as a result can hold, so that a vector
that very many rows share costs one node. Vectors that are null, zero, of another length than most
(of the shorter one, if two are as common), or hold null or non-finite components take no part. Rows
without an id are left out; rows that share an id are all candidates, except for queries of that id,
and repeated rows can fill a result. Ties go to the smaller id. Other columns are not looked at. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.llm.common import stored


def _distances(x: np.ndarray, norms: np.ndarray, of: np.ndarray, to: np.ndarray, to_norm: np.ndarray) -> np.ndarray:
    """Squared distances of points ``x[of]`` (b, m) to vectors ``to`` (b, d)."""
    return norms[of] + to_norm[:, None] - 2 * np.matmul(x[of], to[:, :, None])[:, :, 0]


def search_layer(x: np.ndarray, norms: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once; ids and distances of the ef nearest found, nearest first.

    Each step expands the ``width`` nearest unexpanded nodes of each query's beam.
    """
    b, n = len(queries), len(x)
    q_norm = (queries**2).sum(1)
    seen = np.zeros((b, n + 1), bool)
    ids = np.full((b, ef), n, np.int64)
    dist = np.full((b, ef), np.inf, np.float32)
    done = np.ones((b, ef), bool)
    k = min(entry.shape[1], ef)
    ids[:, :k] = entry[:, :k]
    real = ids[:, :k] < n
    dist[:, :k] = np.where(real, _distances(x, norms, np.minimum(ids[:, :k], n - 1), queries, q_norm), np.inf)
    done[:, :k] = ~real
    np.put_along_axis(seen, ids[:, :k], True, 1)
    seen[:, n] = True
    rows = np.arange(b)
    while len(rows):
        waiting = np.where(done[rows], np.inf, dist[rows])
        w = min(width, ef)
        pick = np.argpartition(waiting, w - 1, 1)[:, :w]
        live = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = live.any(1)
        rows, pick, live = rows[some], pick[some], live[some]
        if not len(rows):
            break
        done[rows[:, None], pick] |= live
        near = links[np.where(live, ids[rows[:, None], pick], n)].reshape(len(rows), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows[:, None], near]] = n
        seen[rows[:, None], near] = True
        new = np.where(near < n, _distances(x, norms, np.minimum(near, n - 1), queries[rows], q_norm[rows]), np.inf)
        all_ids, all_dist = np.concatenate([ids[rows], near], 1), np.concatenate([dist[rows], new], 1)
        all_done = np.concatenate([done[rows], near >= n], 1)
        keep = np.argpartition(all_dist, ef - 1, 1)[:, :ef]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_dist, all_done))
    order = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _diverse(x: np.ndarray, norms: np.ndarray, nodes: np.ndarray, cand: np.ndarray, m: int, most: int = 48) -> np.ndarray:
    """For each node at most m of its candidates: near ones that are nearer to it than to those chosen, then the nearest of the rest."""
    n, out = len(x), np.full((len(nodes), m), len(x), np.int64)
    for at in range(0, len(nodes), 256):
        own, c = nodes[at : at + 256], np.sort(cand[at : at + 256], 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = n
        c[c == own[:, None]] = n
        d = np.where(c < n, _distances(x, norms, np.minimum(c, n - 1), x[own], norms[own]), np.inf)
        order = np.argsort(d, 1, kind="stable")[:, :most]
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[np.minimum(c, n - 1)]
        between = norms[np.minimum(c, n - 1)]
        between = between[:, :, None] + between[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(c.shape, bool)
        for i in range(c.shape[1]):
            hidden = (chosen & (between[:, i, :] < d[:, i : i + 1])).any(1)
            chosen[:, i] = ~hidden & np.isfinite(d[:, i]) & (chosen.sum(1) < m)
        rank = np.argsort(np.where(np.isfinite(d), np.where(chosen, 0, 1), 2), 1, kind="stable")[:, :m]
        best = np.take_along_axis(c, rank, 1)
        out[at : at + 256, : best.shape[1]] = best
    return out


def build_layer(x: np.ndarray, norms: np.ndarray, nodes: np.ndarray, m: int, ef: int, enter: Callable[[np.ndarray], np.ndarray], batch: int = 1024) -> np.ndarray:
    """Links of one layer, (n + 1, 2m) with n for none; ``nodes`` are inserted in their order."""
    n = len(x)
    links = np.full((n + 1, 2 * m), n, np.int64)
    done = 0
    while done < len(nodes):
        new = nodes[done : done + min(batch, max(256, done))]
        inner = norms[new][:, None] + norms[new][None, :] - 2 * x[new] @ x[new].T
        np.fill_diagonal(inner, np.inf)
        k = min(2 * m, len(new))
        cand = new[np.argpartition(inner, k - 1, 1)[:, :k]]
        if done:
            found, _ = search_layer(x, norms, links, x[new], enter(new), ef)
            cand = np.concatenate([found, cand], 1)
        links[new, :m] = _diverse(x, norms, new, cand, m)
        # the other way: each node reached gets the new nodes next to what it has
        to, by = links[new, :m].ravel(), np.repeat(new, m)
        order = np.argsort(to[to < n], kind="stable")
        to, by = to[to < n][order], by[links[new, :m].ravel() < n][order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        extra = np.full((len(targets), int(count.max(initial=1))), n, np.int64)
        extra[np.repeat(np.arange(len(targets)), count), place] = by
        links[targets] = _diverse(x, norms, targets, np.concatenate([links[targets], extra], 1), 2 * m, most=96)
        done += len(new)
    return links


class Graph:
    """Layers of links over a shard's distinct vectors."""

    def __init__(self, vectors: np.ndarray, m: int = 16, ef: int = 80):
        self.place(vectors)
        n = len(vectors)
        draw = np.random.default_rng(7).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(m)).astype(int)
        self.layers: list[np.ndarray] = []
        self.tops = np.flatnonzero(level == level.max())[:8]
        for k in range(level.max(), -1, -1):
            above = list(self.layers)

            def enter(new: np.ndarray, above: list = above) -> np.ndarray:
                return self._descend(self.x[new], above)

            nodes = np.flatnonzero(level >= k)
            # the layer above is part of this one: its nodes go first, so that they can be entered
            self.layers.append(build_layer(self.x, self.norms, nodes[np.argsort(-level[nodes], kind="stable")], m, ef, enter))

    def place(self, vectors: np.ndarray) -> None:
        """The points: vectors as parts of the largest component, so that nothing overflows, and what they lack of the longest one's length."""
        v = vectors / np.abs(vectors).max()
        sizes = (v**2).sum(1)
        self.x = np.concatenate([v, np.sqrt(np.maximum(0, sizes.max() - sizes))[:, None]], 1).astype(np.float32)
        self.norms = (self.x**2).sum(1)

    def _descend(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        at = np.repeat(self.tops[None, :], len(q), 0)
        for links in layers:
            at, _ = search_layer(self.x, self.norms, links, q, at, 8)
        return at

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Nodes (b, k), nearest first, n for none."""
        q = queries / np.abs(queries).max(1, keepdims=True)
        q = np.concatenate([q / np.sqrt((q**2).sum(1, keepdims=True)), np.zeros((len(q), 1))], 1).astype(np.float32)
        found, _ = search_layer(self.x, self.norms, self.layers[-1], q, self._descend(q, self.layers[:-1]), max(ef, k))
        return found[:, :k]


INDEX = "shard int, n int, ids binary, counts binary, vectors binary, layers array<binary>, tops binary"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, for the rows that take part, with one length for all."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda v: v != 0))
    size = x.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return x.where(F.size("embedding") == (size.d if size else 0))


def band_of(embedding: str) -> Column:
    """The power of two below a vector's length, from its largest component and the squares in parts of it, which cannot overflow."""
    state = lambda most, parts: F.struct(most.alias("most"), parts.alias("parts"))

    def add(t: Column, v: Column) -> Column:
        grown = state(v, t["parts"] * (t["most"] / v) * (t["most"] / v) + 1.0)
        return F.when(v > t["most"], grown).when(v > 0, state(t["most"], t["parts"] + (v / t["most"]) * (v / t["most"]))).otherwise(t)

    return F.aggregate(F.transform(embedding, F.abs), state(F.lit(0.0), F.lit(0.0)), add, lambda t: F.floor(F.log2(t["most"]) + F.log2(t["parts"]) / 2)).cast("int")


def build_index(vectors: DataFrame, k: int, shard_rows: int, min_shards: int, m: int = 16, ef: int = 80) -> DataFrame:
    """One row of flat arrays for each shard; equal vectors are one node with its k + 1 smallest ids."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).withColumn("band", band_of("embedding"))
    bands, rows, first = sorted((r.band, r["count"]) for r in vectors.groupBy(band_of("embedding").alias("band")).count().collect()), [], 0
    total = sum(n for _, n in bands)
    for band, n in bands:  # some two thousand at most
        shards = max(math.ceil(n / shard_rows), round(min_shards * n / total), 1)
        rows.append((band, first, shards))
        first += shards
    dealing = vectors.sparkSession.createDataFrame(rows, "band int, first int, shards int")
    dealt = few.join(F.broadcast(dealing), "band").select((F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("shards"))).cast("int").alias("shard"), "vec_id", "embedding")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.array(pdf["embedding"].tolist(), np.float64)
        order = np.lexsort((pdf["vec_id"].to_numpy(), *full.T[::-1]))
        full, ids = full[order], pdf["vec_id"].to_numpy(np.int64)[order]
        starts = np.flatnonzero(np.r_[True, (full[1:] != full[:-1]).any(1)])
        counts = np.diff(np.r_[starts, len(full)])
        mixed = np.random.default_rng(3).permutation(len(starts))  # neighbours in the order of insertion should not be neighbours in space
        ids = np.concatenate([ids[s : s + c] for s, c in zip(starts[mixed], counts[mixed], strict=True)])
        points = full[starts[mixed]]
        graph = Graph(points, m, ef)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(points)], "ids": [ids.tobytes()], "counts": [counts[mixed].astype(np.int64).tobytes()], "vectors": [points.tobytes()], "layers": [[x.astype(np.int32).tobytes() for x in graph.layers]], "tops": [graph.tops.astype(np.int64).tobytes()]})

    return stored(dealt.groupBy("shard").applyInPandas(build, INDEX), "index")


def open_graph(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of an index row, its nodes' ids and numbers of ids, and the vectors."""
    points = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
    g = Graph.__new__(Graph)
    g.place(points)
    g.layers = [np.frombuffer(x, np.int32).reshape(row["n"] + 1, -1).astype(np.int64) for x in row["layers"]]
    g.tops = np.frombuffer(row["tops"], np.int64)
    return g, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64), points


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, ef: int = 160, shard_rows: int = 20_000, min_shards: int = 8, slice_queries: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``.

    About ``min_shards`` shards, or as many as keep a shard at ``shard_rows`` rows. Queries are dealt in
    slices of ``slice_queries``, each with its own copy of the indexes.
    """
    points = stored(valid_vectors(vectors), "vectors")
    n = points.count()
    index = build_index(points, k, shard_rows, min_shards)
    slices = max(1, math.ceil(n / every / slice_queries))
    queries = points.where(F.col("vec_id") % every == 0)
    number = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(slices)).cast("int")
    shards = [r.shard for r in index.select("shard").collect()]
    if not shards:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = queries.select(F.explode(F.array(*map(F.lit, shards))).alias("shard"), number.alias("slice"), "vec_id", "embedding")
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            graph, ids, counts, full = open_graph(left.iloc[0])
            starts = np.cumsum(counts) - counts
            for at in range(0, len(right), 256):
                part = right.iloc[at : at + 256]
                q = np.array(part["embedding"].tolist(), np.float64)
                found = graph.search(q, k + 1, ef)
                for i, own in enumerate(part["vec_id"].tolist()):
                    nodes = found[i][found[i] < len(full)]
                    score = (full[nodes] * q[i]).sum(1)
                    got = np.concatenate([ids[starts[x] : starts[x] + counts[x]] for x in nodes])
                    every_score = np.repeat(score, counts[nodes])
                    order = np.lexsort((got, -every_score))
                    order = order[got[order] != own][:k]
                    out["query_id"].append(np.full(len(order), own))
                    out["vec_id"].append(got[order])
                    out["score"].append(every_score[order])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, kind) for (c, v), kind in zip(out.items(), (np.int64, np.int64, np.float64), strict=True)})

    found = copies.groupBy("shard", "slice").cogroup(asked.groupBy("shard", "slice")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
