"""Small helpers that the operators share: words, hashes, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(SPACED_WORD).findall


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def id_crc32(column: str) -> Column:
    """Unsigned CRC-32 of an id written as text; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


Batches = Iterator[pa.RecordBatch]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Batches:
    """A batch in slices of about ``most`` bytes of text, so that few texts are Python strings at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _give_back() -> None:
    """Return to the system what is free."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What tasks of a kind leave in their Python worker for the next one; a task of another kind clears it."""
    return _kept.setdefault(kind, {})


def _forget(keep: str | None) -> None:
    for kind in [k for k in _kept if k != keep]:
        del _kept[kind]


def row_slices(batch: pa.RecordBatch, most: int) -> Batches:
    """A batch in slices of rows of about ``most`` bytes: the JVM holds each batch whole, outside its heap."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for begin in range(0, max(1, batch.num_rows), step):
        yield batch.slice(begin, step)


def tidied(task: Callable[[Batches], Batches], most: int = 4 << 20, keep: str | None = None) -> Callable[[Batches], Batches]:
    """``task`` for mapInArrow, over slices of about ``most`` bytes if there is a text column; what it gives is sliced so, too.

    Python workers go from task to task, also of other jobs; what one has set free goes back to the system
    at its end, and before the next one begins what only went with the task itself and what tasks of
    other kinds than ``keep`` have kept.
    """

    def run(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())  # the one that gives back what is free
        _forget(keep)
        _give_back()
        try:
            for out in task(x for batch in batches for x in (text_slices(batch, most=most) if "text" in batch.schema.names else (batch,))):
                yield from row_slices(out, most)
        finally:
            _give_back()

    return run


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; only where it is unset (a local session, as in tests) a
    folder is made for this session.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder, in folders by some columns, and read it back: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, when all that was made of them is stored too, so that no stage that could run again reads them.

    The collection on the driver lets Spark delete the shuffle files of jobs that have ended.
    """
    gc.collect()
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def keyed(docs: DataFrame, *columns: str, whole: bool = False) -> DataFrame:
    """``columns`` of ``docs`` with ``_row``, a long of each row's own that stays the same however often the table is read.

    A table that is read from files is keyed by file and place in it; any other one is written first.
    ``whole`` adds ``_whole``, a struct of all columns, whatever their names.
    """
    kept = [F.col(c) for c in columns] + ([F.struct(*docs.columns).alias("_whole")] if whole else [])
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not {"file_path", "row_index"} <= _hidden(docs):
        return stored(docs.select(*kept, F.monotonically_increasing_id().alias("_row")), "keyed")
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    number = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    with_file = docs.select(*kept, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    row = (F.col("_file") * (1 << 40) + F.col("_at")).alias("_row")
    return with_file.join(F.broadcast(number), "_path").select(*columns, *(["_whole"] if whole else []), row)


def _hidden(docs: DataFrame) -> set[str]:
    try:
        return set(docs.select("_metadata.*").columns)
    except AnalysisException:
        return set()


#: Rows up to which a list of rows to drop is broadcast; a key has 8 bytes.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole rows of keyed ``docs`` but for those whose ``_row`` is in ``rows``. A short list is broadcast, a longer one joined by shuffle."""
    rows = stored(rows.select("_row"), "rows")
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    return docs.join(rows, "_row", "left_anti").select("_whole.*")
