"""Exact similarity self-join of word-shingle sets by PartEnum signatures.

A document's set: its distinct shingles of ``width`` words (with fewer words, the whole sequence as
one), each as a 64-bit hash. Two documents link when the Jaccard similarity is at least ``percent``
in a hundred, a comparison in whole numbers.

*Signatures.* Sizes are cut into bands that similar sets cannot leave by more than one. For a band
with largest size r, linked sets differ in at most k = r/4 elements (for 80 percent). The domain of
shingles is cut by hash into n1 partitions and each of these into n2 parts; for every partition the
subsets of n2 - k2 parts are enumerated, and the set's projection onto each subset is a signature. A
partition in which more than k2 parts differ is lost, but k differing elements cannot spoil all of
them, so linked sets share a signature. Empty projections, which all sets would share, are left out:
a set whose non-empty parts cannot be spoiled by k elements needs none (its parts outnumber them).
Shingles that very many sets hold (passages that go round) are left out of the first cut, which only
makes sets more alike. The sets for which the condition then fails, such as those of large families
of copies, use a cut with all shingles too, if that fails a finer one, and of that all signatures,
empty ones included. So no link is missed, whatever is left out.

*Candidates.* Equal sets have one node (their hash), so exact copies never meet as pairs. All nodes
with one signature are a run. First each run's nodes are compared with its hub, the node that shares
most signatures in all; then, of the runs that still have nodes of different components, the pairs
of different components whose sketches are near enough. Large families of near copies are joined by
the first step in linear time (the text that others were copied from is their hub); the second one is
exact for all the rest: a sketch has the parity of the set's elements in each of 1024 stretches of
the domain, so that sets differ in at least as many elements as their sketches in bits. Pairs are
verified on whole sets, and components are found by star contraction.

Documents without words or text (null or empty) link with nothing. Repeated ids: the rows are one
document each, but share the id; a component's name is its smallest id, or null if none of its rows has
one. Texts of any length are whole sets. Ties of hubs go to the larger node, which changes no result.
Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import discard, keyed, stored, tidied
from sigevents.llm.components import components

WIDTH, PERCENT = 5, 80
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words with avalanche."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, 2**bits of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.array([1], np.uint64)
        for k in range(bits):
            p = np.concatenate([p, p * np.uint64(pow(base, 1 << k, 1 << 64))])
        out.append(p)
    return out[0], out[1]


#: Bytes from which a word is hashed by xxhash.
LONG_WORD = 256
#: Bytes hashed at once, as a power of two; longer words are hashed alone.
CHUNK_BITS = 15


def _chunk_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes, in order: differences of one running polynomial over the bytes."""
    space = _SPACE[raw]
    power, inverse = _powers(CHUNK_BITS) if len(raw) <= 1 << CHUNK_BITS else _powers.__wrapped__(len(raw).bit_length())
    value = _BYTE[raw] * power[: len(raw)]
    total = np.cumsum(value)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([np.zeros(int(not space[0]), np.int64), edge, np.full(int(not space[-1]), len(raw), np.int64)])
    begin, last = edge[::2], edge[1::2] - 1
    out = mix((total[last] - total[begin] + value[begin]) * inverse[begin] + (last - begin).astype(np.uint64))
    for i in np.flatnonzero(last - begin >= LONG_WORD):  # long words can be made to agree in such polynomials
        out[i] = xxhash.xxh64_intdigest(raw[begin[i] : last[i] + 1].tobytes().lower())
    return out


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, in order. A long text is hashed in chunks that end at white space."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out, begin = [], 0
    while begin < len(raw):
        end = begin + (1 << CHUNK_BITS)
        if end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[begin:end]])
            while not len(gaps) and end < len(raw):  # a word longer than a chunk
                end += end - begin
                gaps = np.flatnonzero(_SPACE[raw[begin:end]])
            end = begin + int(gaps[-1]) + 1 if len(gaps) else len(raw)
        out.append(_chunk_hashes(raw[begin:end]))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The document's set, sorted."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(width, len(w))
    h = w[: len(w) - n + 1] * (_ODD[0] + np.uint64(2 * n))
    for i in range(1, n):
        h += w[i : len(w) - n + 1 + i] * _ODD[i % 8]
    h = mix(h)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def node_of(s: np.ndarray) -> int:
    """A set's name: a hash of its elements, as a signed 64-bit number."""
    return int(mix(np.array([mix(s, 1).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


@lru_cache
def bands(percent: int = PERCENT, most: int = 1 << 26) -> np.ndarray:
    """Largest sizes of the bands."""
    out, low = [], 1
    while low <= most:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out)


#: Largest size of bands whose partitions have three parts.
SMALL = 64


@lru_cache(4096)
def plan(r: int, level: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """k, n1, n2, k2 for a band. Level 2 is the finer cut.

    Sets of up to SMALL elements have three parts a partition and all pairs of parts for signatures: half
    as many again, each of a third more elements, which short texts of a few common shingles need to be
    told apart. Larger ones have two parts, each its own subset, the least number of signatures.
    """
    k = (100 - percent) * r * (100 + percent) // (percent * (100 + percent))  # elements by which linked sets can differ: r and r/0.8 at most
    if not k:
        return 0, 1, 1, 0
    cells = ceil(0.29 * r + 0.8 * sqrt(r)) + 1
    cells = cells if level < 2 else 2 * cells + 8
    return k, ceil(cells / 2), 3 if r <= SMALL else 2, 1


@lru_cache(256)
def _names(band: int, level: int, n1: int, subsets: int) -> np.ndarray:
    """A number for each partition and subset of a band's cut."""
    at = np.arange(n1 * subsets, dtype=np.uint64) + np.uint64((band * 4 + level) << 40)
    return mix(at, 5).reshape(n1, subsets)


def _cut(s: np.ndarray, mixed: np.ndarray, band: int, r: int, level: int, percent: int) -> tuple[np.ndarray, np.ndarray | None, int, int]:
    """Signatures with something in them, all signatures, elements needed to spoil the former, k.

    ``s`` is sorted, so the parts of the domain are stretches of it.
    """
    k, n1, n2, k2 = plan(r, level, percent)
    if not len(s):
        return s, None, 0, k
    cell = (s >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cells, sums = cell[starts].astype(np.int64), np.add.reduceat(mixed, starts)
    if n2 - k2 == 1:  # the subsets are the parts themselves
        names = _names(band, level, n1, n2).ravel()
        every = None
        if level == 2:
            flat = np.zeros(n1 * n2, np.uint64)
            flat[cells] = sums
            every = mix(flat + names)
        spoil = len(cells) if n2 == k2 + 1 else 0
        return mix(sums + names[cells]), every, spoil, k
    flat, full = np.zeros(n1 * n2, np.uint64), np.zeros(n1 * n2, bool)
    flat[cells], full[cells] = sums, True
    flat, full = flat.reshape(n1, n2), full.reshape(n1, n2)
    subsets = [list(x) for x in combinations(range(n2), n2 - k2)]
    names = _names(band, level, n1, len(subsets))
    every = np.stack([mix(flat[:, x].sum(1) + names[:, j]) for j, x in enumerate(subsets)], 1)
    some = np.stack([full[:, x].any(1) for x in subsets], 1)
    return every[some], every.ravel(), int(np.minimum(full.sum(1), k2 + 1).sum()), k


def signatures(s: np.ndarray, frequent: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set: those of its band, and of the band below if a linked set can be there.

    ``frequent``: sorted shingles to be left out of the first cut.
    """
    tops = bands(percent)
    own = int(np.searchsorted(tops, len(s)))
    rare = s
    if frequent is not None and len(frequent):
        rare = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
    views = [(rare, mix(rare, 2))]
    out = []
    for b in (own, own - 1):
        if b < 0 or (b < own and len(s) * percent > 100 * int(tops[b])):
            continue
        for level in (0, 1, 2):
            if level == len(views):
                again = np.sort(mix(s, 6 + level))
                views.append((again, mix(again, 2 + level)))
            some, every, spoil, k = _cut(*views[level], b, int(tops[b]), level, percent)
            if spoil > k:
                out.append(some)
                break
            out.append(every if level == 2 else some)
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets are similar enough."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


COUNTS = "bucket int, x binary, n binary, nodes binary, sizes binary, ids binary"


def counted_sets(docs: DataFrame, buckets: int, width: int = WIDTH) -> DataFrame:
    """Documents and shingle counts, packed, from one pass over the texts.

    Rows without a bucket hold documents: ids, sizes of their sets, nodes (size 0: no node). Rows
    with one hold shingles that at least three different sets of a task have, and how many do.
    """
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def rows(columns: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return _batch({c: pa.array(columns.get(c, [None] * n), pa.int32() if c == "bucket" else pa.binary()) for c in names})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            times = np.diff(np.r_[first, len(x)])
            x, times = x[first][times > 2], times[times > 2].astype(np.uint32)
            bucket = (x % np.uint64(buckets)).astype(np.int32)
            used = np.unique(bucket).tolist()
            return rows({"bucket": used, "x": [x[bucket == b].tobytes() for b in used], "n": [times[bucket == b].tobytes() for b in used]})

        for batch in batches:
            own_size, own_node = [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, width)
                own_size.append(len(s))
                own_node.append(name := node_of(s) if len(s) else 0)
                if len(s) and name not in seen:
                    seen.add(name)
                    held.append(s)
                    n += len(s)
                if n > 3_000_000:
                    yield flush()
                    held, n = [], 0
                    seen = seen if len(seen) < 500_000 else set()
            ids = batch.column("doc_id")
            void = np.array([i is None for i in ids.to_pylist()], np.uint8).tobytes()
            yield rows({"nodes": [np.array(own_node, np.int64).tobytes()], "sizes": [np.array(own_size, np.uint32).tobytes()], "ids": [void + ids.fill_null(0).to_numpy().tobytes()]})
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidied(count), COUNTS)


def frequent_shingles(counted: DataFrame, buckets: int, often: int = 64, bound: int = 1_000_000) -> np.ndarray:
    """Shingles of at least ``often`` different sets, sorted; the ``bound`` most frequent at most.

    The tasks' counts are summed by bucket. Which shingles are found changes the number of
    candidates and never a result.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [(np.frombuffer(r["x"], np.uint64), np.frombuffer(r["n"], np.uint32)) for batch in batches for r in batch.to_pylist()]
        if x:
            value, where = np.unique(np.concatenate([v for v, _ in x]), return_inverse=True)
            times = np.bincount(where, np.concatenate([n for _, n in x]))
            best = np.argsort(-times, kind="stable")[: bound // buckets + 1]
            best = best[times[best] >= often]
            yield _batch({"x": pa.array([value[best].tobytes()], pa.binary())})

    found = counted.where("bucket is not null").select("bucket", "x", "n").repartition(buckets, "bucket").mapInArrow(tidied(total), "x binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.x, np.uint64) for r in found)]))[:bound]


PACK = "bucket int, sigs binary, nodes binary, sizes binary"


def set_packs(docs: DataFrame, buckets: int, frequent: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Signatures of all sets by bucket, packed, each with its node and the size of its set.

    Of a signature, the bucket and 40 bits more are kept. Buckets hold about as many signatures at
    any size of the input, so that few of these agree by chance, which adds candidates and loses no
    link. A task sends each node's signatures once, however many copies it holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(sigs)
            of = np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(x) for x in sigs])
            bucket = (whole % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            n, m = np.array(nodes, np.int64), np.array(sizes, np.uint32)
            m = m if m.max() >> 16 else m.astype(np.uint16)
            low, high = (whole // np.uint64(buckets)).astype(np.uint32), (whole // np.uint64(buckets) >> np.uint64(32)).astype(np.uint8)
            out: list[list] = [[], [], [], []]
            for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                take = order[ends[b] : ends[b + 1]]
                for column, x in zip(out, (b, low[take].tobytes() + high[take].tobytes(), n[of[take]].tobytes(), m[of[take]].tobytes()), strict=True):
                    column.append(x)
            return _batch({"bucket": pa.array(out[0], pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip(("sigs", "nodes", "sizes"), out[1:], strict=True)})

        held = 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                s = shingles(t, width)
                if not len(s) or (name := node_of(s)) in seen:
                    continue
                seen.add(name)
                sigs.append(signatures(s, shared.value, percent))
                nodes.append(name)
                sizes.append(len(s))
                held += len(sigs[-1])
                if held > 700_000:
                    yield flush()
                    held, sigs, nodes, sizes = 0, [], [], []
                    if len(seen) > 500_000:
                        seen.clear()
        if sigs:
            yield flush()

    return docs.select("text").mapInArrow(tidied(run), PACK)


def set_table(counted: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null for empty sets), from the rows of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, ids in zip(batch.column("nodes"), batch.column("sizes"), batch.column("ids"), strict=True):
                node, n = np.frombuffer(nodes.as_py(), np.int64), np.frombuffer(sizes.as_py(), np.uint32).astype(np.int64)
                raw = ids.as_py()
                void = np.frombuffer(raw, np.uint8, len(n)).astype(bool)
                yield _batch({"doc_id": pa.array(np.frombuffer(raw[len(n) :], np.int64), mask=void), "n_shingles": pa.array(n), "node": pa.array(node, mask=n == 0)})

    return counted.where("bucket is null").select("nodes", "sizes", "ids").mapInArrow(tidied(run), "doc_id long, n_shingles long, node long")


def _signatures_of(raw: bytes, n: int) -> np.ndarray:
    """The 40 bits of each of ``n`` signatures: the low four bytes of all, then the high ones."""
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _runs_of(rows: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and sizes of each distinct run of a bucket: nodes, in order, that share a signature."""
    nodes = [np.frombuffer(r["nodes"], np.int64) for r in rows]
    sigs = np.concatenate([_signatures_of(r["sigs"], len(n)) for r, n in zip(rows, nodes, strict=True)])
    sizes = np.concatenate([np.frombuffer(r["sizes"], f"<u{len(r['sizes']) // len(n)}").astype(np.uint32) for r, n in zip(rows, nodes, strict=True)])
    nodes = np.concatenate(nodes)
    order = np.argsort(sigs, kind="stable")
    sigs = sigs[order]
    again = np.r_[False, sigs[1:] == sigs[:-1]]
    part = again | np.r_[again[1:], False]
    nodes, sizes, again = nodes[order][part], sizes[order][part], again[part]
    starts = np.flatnonzero(~again)
    known: set[tuple[int, int]] = set()
    for b, e in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)], strict=True):
        n, first = np.unique(nodes[b:e], return_index=True)
        if len(n) < 2:
            continue
        key = (len(n), int(mix(n.view(np.uint64), 3).sum(dtype=np.uint64)))
        if key not in known:
            known.add(key)
            yield n, sizes[b:e][first]


def runs(packs: DataFrame) -> DataFrame:
    """Distinct runs of nodes that share a signature; each has its nodes and their sizes, packed."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the partition is sorted by bucket: one bucket is held at a time
        bucket, held = None, []
        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] != bucket and held:
                    yield from pack(held)
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield from pack(held)

    def pack(held: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes = [], [], []
        for n, m in _runs_of(held):
            keys.append(int(np.int64(xxhash.xxh64_intdigest(n.tobytes()) - (1 << 63))))
            nodes.append(n.tobytes())
            sizes.append(m.tobytes())
        yield _batch({"run": pa.array(keys, pa.int64()), "nodes": pa.array(nodes, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    found = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "run long, nodes binary, sizes binary")
    return found.dropDuplicates(["run"])


def run_nodes(found: DataFrame) -> DataFrame:
    """run, n, node, size: a row for each node of each run of ``n`` nodes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = ([np.frombuffer(x.as_py(), kind) for x in batch.column(c)] for c, kind in (("nodes", np.int64), ("sizes", np.uint32)))
            n = np.array(list(map(len, nodes)), np.int64)
            if len(n):
                columns = (np.repeat(batch.column("run").to_numpy(), n), np.repeat(n, n), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64))
                yield _batch({c: pa.array(x, pa.int64()) for c, x in zip(("run", "n", "node", "size"), columns, strict=True)})

    return found.mapInArrow(tidied(unpack), "run long, n long, node long, size long")


def star_pairs(flat: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each run's hub with each other node of a size that can link. The hub is the node of most weight, the sum of the sizes of its runs."""
    weights = flat.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    hubs = flat.join(weights, "node").groupBy("run").agg(F.max(F.struct("weight", "node", "size")).alias("hub"))
    met = flat.join(hubs, "run").where("node <> hub.node")
    fit = F.least("size", "hub.size") * 100 >= F.greatest("size", "hub.size") * percent
    return met.where(fit).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _pair_batches(parts: Iterator[np.ndarray], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Distinct pairs, in batches of about ``most``."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        both = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        key = mix(both[:, 0].view(np.uint64), 21) ^ mix(both[:, 1].view(np.uint64), 22)
        both = both[np.unique(key, return_index=True)[1]]
        return _batch({"a": pa.array(np.ascontiguousarray(both[:, 0])), "b": pa.array(np.ascontiguousarray(both[:, 1]))})

    for x in parts:
        held.append(x)
        n += len(x)
        if n > most:
            yield out()
            held, n = [], 0
    yield out()


#: Bits of a node's sketch, and the nodes of a run that one task compares with all of the run.
SKETCH_BITS, RUN_BLOCK = 1024, 20_000


def sketch(s: np.ndarray) -> bytes:
    """For each of SKETCH_BITS stretches of the domain, whether the set has an odd number of elements there.

    Each bit in which two sketches differ takes an element that only one of the sets has.
    """
    odd = np.bincount((s >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def mixed_rows(flat: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of runs of three or more nodes (with two, the hub and the other were compared) of different components, with ``component``.

    ``labels``: node, component for nodes that have one.
    """
    flat = flat.where("n > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = flat.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("run")
    return flat.join(mixed, "run").select("run", "n", "node", "size", "component")


def sketches(docs: DataFrame, names: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, sketch of the nodes of a table."""
    need = stored(nodes.select("node").distinct().join(names, "node").select("doc_id").distinct(), "need")
    if need.count() <= BROADCAST_PAIRS:
        need = F.broadcast(need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in (shingles(t, width) for t in batch.column("text").to_pylist()) if len(s)]
            yield _batch({"node": pa.array([node_of(s) for s in found], pa.int64()), "sketch": pa.array([sketch(s) for s in found], pa.binary())})

    return docs.join(need, "doc_id", "left_semi").select("text").mapInArrow(tidied(run), "node long, sketch binary").dropDuplicates(["node"])


def rest_pairs(docs: DataFrame, names: DataFrame, runs_: DataFrame, labels: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Pairs of nodes of one run that are of different components and that sizes and sketches let link.

    A long run is dealt to several tasks, each of which compares RUN_BLOCK of its nodes with all: beyond RUN_BLOCK nodes
    both rows and comparisons grow with the square of what is left in a run after the first step.
    Pairs whose sketches differ in more bits than linked sets have differing elements are left out
    where they are made, so what is sent on is near the pairs that link.
    """
    flat = stored(mixed_rows(runs_, labels), "mixed")
    flat = flat.join(sketches(docs, names, flat, width), "node")
    flat = flat.withColumn("parts", F.ceil(F.col("n") / RUN_BLOCK).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    flat = flat.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")) == F.col("part"))

    def compare(rows: list[pa.RecordBatch]) -> Iterator[np.ndarray]:
        node, size, label, mine = (np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows]) for c in ("node", "size", "component", "mine"))
        bits = np.frombuffer(b"".join(x for r in rows for x in r.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        own = np.flatnonzero(mine)
        step = max(1, 200_000 // len(node))
        for at in range(0, len(own), step):
            i = own[at : at + step]
            apart = np.zeros((len(i), len(node)), np.int64)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[i, k, None] ^ bits[:, k])
            both = size[i, None] + size
            fit = (apart * (100 + percent) <= both * (100 - percent)) & (label[i, None] != label) & (node[i, None] < node)
            fit &= np.minimum(size[i, None], size) * 100 >= np.maximum(size[i, None], size) * percent
            x, y = np.nonzero(fit)
            yield np.stack([node[i[x]], node[y]], 1)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        # sorted by run and part: one of them is held at a time
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("run", "part")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if last != (now := tuple(key[b].tolist())) and held:
                    yield from compare(held)
                    held = []
                last = now
                held.append(batch.slice(b, e - b))
        if held:
            yield from compare(held)

    dealt = flat.repartition("run", "part").sortWithinPartitions("run", "part").select("run", "part", "node", "size", "component", "mine", "sketch")
    return dealt.mapInArrow(tidied(lambda batches: _pair_batches(pairs(batches))), "a long, b long").distinct()


#: Pairs up to which the rows to be verified are picked by a broadcast join; a pair takes about 100 bytes.
BROADCAST_PAIRS = 500_000
#: Members of one least node that are verified in one go.
SALT_ROWS = 2_000


def verify(docs: DataFrame, names: DataFrame, pairs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs that link. ``names``: node, doc_id (a key of one row) of one document that has the set.

    The members of a node ``a`` are dealt over salts of about SALT_ROWS, each with a copy of the
    set of ``a``; a task streams through them and holds two sets at a time.
    """
    pairs = stored(pairs, "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("k"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    few = pairs.count() <= BROADCAST_PAIRS
    need = stored(members.union(heads).join(names, "node").groupBy("doc_id").agg(F.collect_list(F.struct("a", "salt", "role", "node")).alias("roles")), "need")
    if few:
        need = F.broadcast(need)
    rows = docs.select("doc_id", "text").join(need, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, salt, role, node, raw = [], [], [], [], []
            for t, roles in zip(batch.column("text").to_pylist(), batch.column("roles").to_pylist(), strict=True):
                s = shingles(t, width)
                name, s = node_of(s), s.tobytes()
                for r in roles:
                    if r["node"] != name:  # another text of the same id
                        continue
                    a.append(r["a"])
                    salt.append(r["salt"])
                    role.append(r["role"])
                    node.append(r["node"])
                    raw.append(s)
                if sum(map(len, raw)) > 1 << 23:
                    yield _batch({"a": pa.array(a, pa.int64()), "salt": pa.array(salt, pa.int32()), "role": pa.array(role, pa.int32()), "node": pa.array(node, pa.int64()), "raw": pa.array(raw, pa.binary())})
                    a, salt, role, node, raw = [], [], [], [], []
            yield _batch({"a": pa.array(a, pa.int64()), "salt": pa.array(salt, pa.int32()), "role": pa.array(role, pa.int32()), "node": pa.array(node, pa.int64()), "raw": pa.array(raw, pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, whose = None, None
        for batch in batches:
            a, b = [], []
            for x, salt, role, node, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "node")), batch.column("raw"), strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                if not role:
                    head, whose = s, (x, salt)
                elif whose == (x, salt) and linked(head, s, percent):
                    a.append(x)
                    b.append(node)
            yield _batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = rows.select("text", "roles").mapInArrow(tidied(sets), "a long, salt int, role int, node long, raw binary")
    return dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(tidied(compare), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bucket_signatures: int = 700_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows = row_components(keyed(docs, "doc_id", "text"), width, percent, bucket_signatures)
    return rows.select("doc_id", "n_shingles", "component_id")


def spare_rows(docs: DataFrame) -> DataFrame:
    """_row of each row of keyed ``docs`` but one of each component: the one of the smallest id, and of those the first."""
    rows = stored(row_components(docs).where("component is not null").select("doc_id", "_row", "component"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    return rows.join(rows.groupBy("component").agg(F.min(order).alias("first")), "component").where("_row <> first._row").select("_row")


def row_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bucket_signatures: int = 700_000) -> DataFrame:
    """doc_id, _row, n_shingles, component (null without shingles), component_id of every row of keyed ``docs``.

    Texts are found again by the row's key: ids may be null, or stand for several texts.
    """
    ids = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"))
    docs = docs.select(F.col("_row").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, ceil(size / 9 / bucket_signatures))  # about one signature to nine bytes of text
    counted = stored(counted_sets(docs, min(buckets, 200), width), "counts")
    frequent = frequent_shingles(counted, min(buckets, 200))
    sets = stored(set_table(counted).withColumnRenamed("doc_id", "_row").join(ids, "_row"), "sets")
    discard(counted)
    # of each set a row that has it, and the smallest id
    names = stored(sets.where("node is not null").groupBy("node").agg(F.min("_row").alias("doc_id"), F.min("doc_id").alias("least")), "names")
    flat = stored(run_nodes(runs(set_packs(docs, buckets, frequent, width, percent))), "runs")
    links = stored(verify(docs, names, star_pairs(flat, percent), width, percent), "links")
    labels = stored(components(links), "labels")
    more = stored(verify(docs, names, rest_pairs(docs, names, flat, labels, width, percent), width, percent), "links")
    if more.limit(1).count():
        labels = stored(components(links.union(more)), "labels")
    # a component's name: the smallest id of its nodes' smallest ids
    labelled = names.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    by_node = labelled.join(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")
    return sets.join(by_node, "node", "left").select("doc_id", "_row", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


#: The same rows as near_duplicates(documents).
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""
