"""Token-id files: ids in chunks of whole documents, byte or bit planes of fixed-size blocks, zstandard.

A chunk is one binary record that holds whole documents. Its ids, unsigned 32-bit, are cut into
blocks of ``block`` ids (the last one is padded with zeros); each block is transposed into 4 byte
planes or 32 bit planes, and each plane, over all blocks of the chunk, is compressed on its own, so
that planes that are always zero cost next to nothing. The table that holds the chunks is their
index: shard, chunk, first document, numbers of documents and ids, and the ids of the shard before.
It is written by Spark's own Parquet writer, so lost executors and any file system are its matter.

Null texts count as empty and get the end id alone. Rows with the same id are all kept, in order of
their texts; equal rows follow one another. Null ids come first. A text of any length is encoded
whole and lies in one chunk. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigevents.llm.common import scratch_path, tidied
from sigevents.llm.tokens import KEPT, encoder

_HEAD = struct.Struct("<4sBIQI")
_MAGIC = b"PLN1"
CHUNK_SCHEMA = "shard int, chunk int, shard_start long, first_doc_id long, n_docs int, n_ids long, payload binary"


def pack_planes(ids: np.ndarray, block: int = 1 << 14, planes: str = "byte") -> list[bytes]:
    """Compressed planes of an array of ids."""
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    cells = padded.view(np.uint8).reshape(-1, block, 4)
    if planes == "bit":
        bits = np.unpackbits(cells, axis=2, bitorder="little")
        cells = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").transpose(2, 0, 1).transpose(1, 2, 0)
        rows = [cells[:, k] for k in range(32)]
    else:
        rows = [cells[:, :, k] for k in range(4)]
    squeeze = zstandard.ZstdCompressor(level=3)
    return [squeeze.compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def unpack_planes(parts: list[bytes], n: int, block: int, planes: str) -> np.ndarray:
    """The ids again."""
    open_up = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(open_up.decompress(p), np.uint8) for p in parts]
    blocks = -(-n // block)
    if planes == "bit":
        bits = np.stack([np.unpackbits(r.reshape(blocks, -1), axis=1, bitorder="little") for r in raw], axis=2)
        cells = np.packbits(bits, axis=2, bitorder="little")
    else:
        cells = np.stack([r.reshape(blocks, block) for r in raw], axis=2)
    return np.ascontiguousarray(cells).view("<u4").ravel()[:n]


def pack_chunk(doc_ids: list[int | None], lengths: np.ndarray, flat: np.ndarray, block: int = 1 << 14, planes: str = "byte") -> bytes:
    """One record: header, document ids and lengths, planes of all their ids."""
    squeeze = zstandard.ZstdCompressor(level=3)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    docs = np.array([x or 0 for x in doc_ids], "<i8")
    parts = [squeeze.compress(docs.tobytes() + known.tobytes() + lengths.astype("<u4").tobytes()), *(pack_planes(flat, block, planes) if len(flat) else [])]
    head = _HEAD.pack(_MAGIC, planes == "bit", block, len(flat), len(doc_ids))
    return head + struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def unpack_chunk(record: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths, ids."""
    magic, bit, block, n, n_docs = _HEAD.unpack_from(record)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token planes")
    at = _HEAD.size
    (k,) = struct.unpack_from("<I", record, at)
    sizes = struct.unpack_from(f"<{k}I", record, at + 4)
    at += 4 + 4 * k
    parts = []
    for s in sizes:
        parts.append(record[at : at + s])
        at += s
    meta = zstandard.ZstdDecompressor().decompress(parts[0])
    docs = np.frombuffer(meta, "<i8", n_docs)
    known = np.frombuffer(meta, np.uint8, n_docs, 8 * n_docs)
    lengths = np.frombuffer(meta, "<u4", n_docs, 9 * n_docs)
    ids = unpack_planes(parts[1:], n, block, "bit" if bit else "byte") if n else np.zeros(0, "<u4")
    return [d if k else None for d, k in zip(docs.tolist(), known, strict=True)], lengths, ids


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, chunk_ids: int = 1 << 18, block: int = 1 << 14, planes: str = "byte", pieces: int = 400_000, text_bytes: int = 4 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write chunks in ascending order of doc_id.

    Range partitioning by the id gives shards whose order is the order of ids; each shard is
    streamed, so a task holds ``text_bytes`` of texts, one chunk, and the ids of ``pieces`` pieces it has seen.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pieces)
        number, chunk, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []  # of the documents in ``names``, and their lengths
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            flat, lengths = np.concatenate(ids), np.concatenate(sizes)
            row = [[number], [chunk], [start], [names[0]], [len(names)], [len(flat)], [pack_chunk(names, lengths, flat, block, planes)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            flat, size = enc.encode(batch.column("text"))
            ends = np.cumsum(size)
            flat, size = np.insert(flat, ends, end_id), size + 1
            ends, keys, done = np.cumsum(size), batch.column("doc_id").to_pylist(), 0
            while done < len(keys):  # documents up to the one that fills the chunk
                held, before = sum(map(len, ids)), int(ends[done - 1]) if done else 0
                to = min(len(keys), int(np.searchsorted(ends, before + chunk_ids - held)) + 1)
                names += keys[done:to]
                sizes.append(size[done:to])
                ids.append(flat[before : ends[to - 1]])
                if held + len(ids[-1]) >= chunk_ids:
                    yield flush()
                    chunk, start, ids, names, sizes = chunk + 1, start + held + len(ids[-1]), [], [], []
                done = to
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidied(shard, text_bytes, KEPT), CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file: doc_id, start, n_tokens, ids_crc32, in no order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, record in zip(batch.column("shard").to_pylist(), batch.column("shard_start").to_pylist(), batch.column("payload"), strict=True):
                docs, lengths, ids = unpack_chunk(record.as_py())
                ends = np.cumsum(lengths, dtype="int64")
                begins = ends - lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(begins + start, pa.int64()), pa.array(docs, pa.int64()), pa.array(lengths.astype("int64")), pa.array(crc, pa.int64())], names=["shard", "at", "doc_id", "n_tokens", "ids_crc32"])

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    docs = chunks.select("shard", "shard_start", "payload").mapInArrow(tidied(rows), "shard int, at long, doc_id long, n_tokens long, ids_crc32 long")
    # one number for each shard, of which there are as many as write tasks
    base, bases = 0, []
    for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        bases.append((r.shard, base))
        base += r.n
    return docs.join(spark.createDataFrame(bases, "shard int, base long"), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, **how) -> DataFrame:
    """Write the token file of ``docs`` to the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer, end_id, **how)
    return read_token_file(docs.sparkSession, path)
