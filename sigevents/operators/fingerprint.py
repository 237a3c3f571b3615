"""SHA-256 of whole files of any size, no task of which reads a file.

Spark's text reader gives a file's bytes by splits, cut at line feeds alone, so that large files are read by
many tasks; lines are put together again and stored by piece of the file. SHA-256 is sequential: the pieces
of a file are hashed in turn, a job for each piece of the longest file, and a task takes the hash's state
from the job before and reads one piece of each of its files. What the reader takes off (a byte order mark
at the begin, the last line feed) is known from the file's length; a length that does not fit is an error,
as of files that the reader would decompress. Files without a byte are not listed by Spark.
"""

from __future__ import annotations

import _hashlib
import ctypes
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigevents.sources.scratch import scratch_path, stored

#: Bytes of a file that one task hashes.
PIECE = 128 << 20
MARK = b"\xef\xbb\xbf"
#: Bytes of OpenSSL's state of a SHA-256.
STATE = 112


class Sha256:
    """A SHA-256 whose state another task can go on from, which hashlib's does not let out."""

    def __init__(self, state: bytes | None = None) -> None:
        self.lib = ctypes.CDLL(_hashlib.__file__)  # with the OpenSSL that it is linked to
        self.lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        self.held = ctypes.create_string_buffer(state or b"", STATE)
        if state is None:
            self.lib.SHA256_Init(self.held)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.held, data, len(data))

    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.held.raw, STATE))
        return out.raw.hex()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each batch and split as one chunk, each with its line feed; ``n`` numbers them in a split."""
    last, n = None, 0
    for batch in batches:
        names = zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True)
        begin, out = 0, []
        for split, some in groupby(names):
            end = begin + sum(1 for _ in some)
            last, n = split, n + 1 if split == last else 0
            out.append((*split, n, b"\n".join([*batch.column("value").slice(begin, end - begin).to_pylist(), b""])))
            begin = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "at", "n", "content"])


HASHED = "file string, path string, size long, mark boolean, done long, state binary"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's row with the state after its chunks, which follow it in order."""
    names = [c.split()[0] for c in HASHED.split(", ")]
    held, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([held | {"state": sha.state()}], pa.schema([("file", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mark", pa.bool_()), ("done", pa.int64()), ("state", pa.binary())]))

    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in [*names, "n", "content"]}
            if r["n"] < 0:
                if held is not None:
                    yield row()
                held, sha = {c: r[c] for c in names}, Sha256(r["state"])
                if r["state"] is None and r["mark"]:
                    sha.update(MARK)
                    held["done"] = len(MARK)
                continue
            some = r["content"][: held["size"] - held["done"]]  # without a last line feed that the file does not have
            sha.update(some)
            held["done"] += len(some)
    if held is not None:
        yield row()


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [Sha256(s).hexdigest() for s in batch.column("state").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(done, pa.string())], names=["path", "sha256"])


def content_fingerprint(spark: SparkSession, root: str, glob: str = "*", piece_bytes: int = PIECE) -> DataFrame:
    """path, sha256 of the files below a folder."""
    how = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    found = spark.read.format("binaryFile").options(**how).load(root).select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"))
    lines = spark.read.options(**how, lineSep="\n").text(root).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    chunks = lines.mapInArrow(_packed, "file string, at long, n long, content binary").withColumn("piece", F.expr(f"at div {piece_bytes}"))
    place = scratch_path(spark, "chunks")
    chunks.write.partitionBy("piece").parquet(place)
    chunks = spark.read.schema("file string, at long, n long, content binary, piece long").parquet(place)
    total = chunks.groupBy("file").agg(F.sum(F.octet_length("content")).alias("_read"))
    more = F.coalesce("_read", F.lit(0)) - F.col("size")
    fits = F.when(more.isin(0, 1, -2, -3), more < 0).otherwise(F.raise_error(F.concat(F.lit("read otherwise than stored: "), "path")))
    states = stored(found.join(total, "file", "left").select("file", "path", "size", fits.alias("mark"), F.lit(0).cast("long").alias("done"), F.lit(None).cast("binary").alias("state")), "states")
    last, size = chunks.agg(F.max("piece")).first()[0], states.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // piece_bytes)
    for k in range((last or 0) + 1):
        first = states.withColumns({"at": F.lit(-1).cast("long"), "n": F.lit(-1).cast("long"), "content": F.lit(None).cast("binary")})
        some = first.unionByName(chunks.where(F.col("piece") == k).drop("piece"), allowMissingColumns=True)
        states = stored(some.repartition(tasks, F.xxhash64("file")).sortWithinPartitions("file", "at", "n").mapInArrow(_carried, HASHED), "states")
    return states.mapInArrow(_finished, "path string, sha256 string")
