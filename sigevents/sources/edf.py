"""EDF recordings as a Spark data source that reads ranges of a file.

A file is planned as byte ranges of ``split_bytes`` from its size alone; each task reads the header and,
by seeking, the data records of the blocks that begin in its range, so a long recording is read by many
tasks and none holds a file; small files are read several by a task. Rows are blocks of ``block_s`` seconds of a channel, in order of time, then
of the header, with the samples in physical units. With ``ahead_s``, a task also gives the blocks after
its range that begin within so many seconds, marked ``ahead``: what windows that begin in the range need.

A record that is cut off at the end of the file is left out, and so are records beyond the header's
count; a count of -1 means as many as there are. In a discontinuous file (EDF+D) each data record is a
block of its own, at the onset its annotations tell. Annotation channels give no rows. A header that
cannot be read is an error that names the file. Files are those below the path that end in ``.edf``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNALS = "recording_id string, channel string, block_idx int, start_s double, fs int, samples array<float>"
# Widths of the fixed part's and of each signal's header fields.
SIGNAL_FIELDS = (("label", 16), ("kind", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("n", 8))
FIXED, PER_SIGNAL = 256, 256


@dataclass(frozen=True)
class Header:
    """What a file's header tells; ``n``: samples of each signal in a data record."""

    bytes: int
    records: int
    seconds: float
    discontinuous: bool
    labels: tuple[str, ...]
    n: tuple[int, ...]
    gain: tuple[float, ...]
    offset: tuple[float, ...]

    @property
    def record_bytes(self) -> int:
        return 2 * sum(self.n)

    def rate(self, i: int) -> int:
        return round(self.n[i] / self.seconds) if self.seconds else self.n[i]

    @property
    def channels(self) -> list[int]:
        """Signals that are no annotations."""
        return [i for i, label in enumerate(self.labels) if "annotation" not in label.lower()]


def signals_of(fixed: bytes) -> int:
    """The number of signals, from the first FIXED bytes."""
    return int(fixed[252:256])


def parse_header(raw: bytes, size: int) -> Header:
    """``raw``: the header's bytes; ``size``: of the whole file."""
    text = lambda a, n: raw[a : a + n].decode("latin1").strip()
    length, records, seconds, ns = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    at, fields = FIXED, {}
    for name, width in SIGNAL_FIELDS:
        fields[name] = [text(at + i * width, width) for i in range(ns)]
        at += ns * width
    n = tuple(int(x) for x in fields["n"])
    there = (size - length) // (2 * sum(n)) if sum(n) else 0
    p0, p1, d0, d1 = ([float(x) for x in fields[k]] for k in ("pmin", "pmax", "dmin", "dmax"))
    gain = tuple((b - a) / (d - c) if d != c else 1.0 for a, b, c, d in zip(p0, p1, d0, d1, strict=True))
    offset = tuple(a - c * g for a, c, g in zip(p0, d0, gain, strict=True))
    return Header(length, there if records < 0 else min(records, there), seconds, text(192, 5) == "EDF+D", tuple(fields["label"]), n, gain, offset)


def decode_records(raw: bytes, header: Header) -> list[np.ndarray]:
    """Physical samples of each signal of some whole data records."""
    table, begin, out = np.frombuffer(raw, "<i2").reshape(-1, sum(header.n)), 0, []
    for n, gain, offset in zip(header.n, header.gain, header.offset, strict=True):
        out.append(table[:, begin : begin + n].ravel() * gain + offset)
        begin += n
    return out


def onset(raw: bytes, header: Header) -> float | None:
    """Seconds at which a data record begins, by its first time-stamped annotation."""
    begin = 0
    for label, n in zip(header.labels, header.n, strict=True):
        if "annotation" in label.lower():
            stamp = raw[begin : begin + 2 * n].split(b"\x14", 1)[0].split(b"\x15", 1)[0]
            return float(stamp) if stamp[:1] in b"+-" and stamp else None
        begin += 2 * n
    return None


class Blocks:
    """The blocks of a file, by number: which records they need, and their rows."""

    def __init__(self, header: Header, block_s: int) -> None:
        self.header, self.block_s = header, block_s
        h = header
        self.steps = {i: max(1, h.rate(i) * block_s) for i in h.channels}  # samples of a block
        if h.discontinuous:
            self.count = h.records
        else:
            self.count = max((-(-h.records * h.n[i] // s) for i, s in self.steps.items() if h.n[i]), default=0)

    def first_record(self, k: int) -> int:
        if self.header.discontinuous:
            return k
        return min(k * s // self.header.n[i] for i, s in self.steps.items() if self.header.n[i])

    def end_record(self, k: int) -> int:
        if self.header.discontinuous:
            return k + 1
        return min(self.header.records, max(-(-(k + 1) * s // self.header.n[i]) for i, s in self.steps.items() if self.header.n[i]))

    def owned(self, begin: int, end: int) -> range:
        """Blocks whose first record begins in a range of the file's bytes."""
        h = self.header

        def least(at: int) -> int:
            lo, hi = 0, self.count
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if h.bytes + self.first_record(mid) * h.record_bytes >= at else (mid + 1, hi)
            return lo

        return range(least(begin), least(end))

    def rows(self, k: int, raw: bytes) -> Iterator[tuple[str, int, float, int, np.ndarray]]:
        """channel, block, start, rate, samples; ``raw``: the records from first_record to end_record."""
        h, begin = self.header, self.first_record(k)
        samples = decode_records(raw, h)
        for i in h.channels:
            if h.discontinuous:
                at = onset(raw, h)
                x, start = samples[i], k * h.seconds if at is None else at
            else:
                a = k * self.steps[i]
                x, start = samples[i][a - begin * h.n[i] : a + self.steps[i] - begin * h.n[i]], a / h.rate(i) if h.rate(i) else 0.0
            if len(x):
                yield h.labels[i], k, start, h.rate(i), x.astype(np.float32)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of recording_id, channel, block_idx, start_s, fs, samples, ahead as a batch."""
    ids, channels, blocks, starts, rates, samples, ahead = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, samples)]).astype(np.int32)
    columns = [pa.array(ids), pa.array(channels), pa.array(blocks, pa.int32()), pa.array(starts, pa.float64()), pa.array(rates, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(samples), pa.float32())), pa.array(ahead)]
    return pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in SIGNALS.split(", ")), "ahead"])


#: Up to so many ranges are a task each; of more, a task has several, of as many bytes as that takes, TASK_BYTES at most.
TASKS, TASK_BYTES = 128, 1 << 20
#: Samples of a batch of rows; a block is not cut.
BATCH_SAMPLES = 100_000


@dataclass
class Ranges(InputPartition):
    """Ranges of bytes of files: path, begin, end."""

    parts: list[tuple[str, int, int]]


class EdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.block_s = int(options.get("block_s", 60))
        self.split_bytes = int(options.get("split_bytes", 32 << 20))
        self.ahead_s = float(options.get("ahead_s", 0))

    def partitions(self) -> list[Ranges]:
        system, root = fs.FileSystem.from_uri(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, small, held = [], [], 0  # parts of tasks, with their bytes
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.path.lower().endswith(".edf"):
                continue
            if f.size > self.split_bytes:
                out += [([(f.path, b, b + self.split_bytes)], min(self.split_bytes, f.size - b)) for b in range(0, f.size, self.split_bytes)]
                continue
            if small and held + f.size > self.split_bytes:
                out.append((small, held))
                small, held = [], 0
            small.append((f.path, 0, self.split_bytes))
            held += f.size
        out.append((small, held))
        if len(out) <= TASKS:
            return [Ranges(parts) for parts, _ in out]
        most = min(TASK_BYTES, sum(n for _, n in out) // TASKS)
        dealt, held = [[]], 0
        for parts, n in out:
            if dealt[-1] and held + n > most:
                dealt.append([])
                held = 0
            dealt[-1] += parts
            held += n
        return [Ranges(parts) for parts in dealt]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, parts in groupby(partition.parts, key=lambda p: p[0]):
            for some in self._blocks(path, [p[1:] for p in parts]):
                rows += some
                held += sum(len(r[5]) for r in some)
                if held >= BATCH_SAMPLES:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    def _blocks(self, path: str, parts: list[tuple[int, int]]) -> Iterator[list[tuple]]:
        """Rows of each block of some ranges of a file."""
        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(path) as f:
            try:
                fixed = f.read_at(FIXED, 0)
                header = parse_header(f.read_at(FIXED + PER_SIGNAL * signals_of(fixed), 0), f.size())
            except (ValueError, IndexError) as e:
                raise ValueError(f"no EDF header: {path}") from e
            blocks, name = Blocks(header, self.block_s), path.rsplit("/", 1)[-1].rsplit(".", 1)[0]

            def block(k: int, ahead: bool) -> list[tuple]:
                a, b = blocks.first_record(k), blocks.end_record(k)
                raw = f.read_at((b - a) * header.record_bytes, header.bytes + a * header.record_bytes)
                return [(name, *r, ahead) for r in blocks.rows(k, raw)]

            for first, last in parts:
                own = blocks.owned(first, last)
                for k in own:
                    yield block(k, False)
                begin = None
                for k in range(own.stop, blocks.count) if len(own) and self.ahead_s > 0 else ():
                    rows = block(k, True)
                    start = rows[0][3] if rows else 0.0
                    begin = start if begin is None else begin
                    if start >= begin + self.ahead_s:
                        break
                    yield rows


class EdfSource(DataSource):
    """``spark.read.format("edf_signals").option("block_s", 60).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "edf_signals"

    def schema(self) -> str:
        return SIGNALS + ", ahead boolean"

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)


def read_edf_ranges(spark: SparkSession, root: str, block_s: int = 60, split_bytes: int = 32 << 20, ahead_s: float = 0) -> DataFrame:
    """Blocks of all EDF files below a folder, with ``ahead``; see the module."""
    spark.dataSource.register(EdfSource)
    return spark.read.format("edf_signals").options(block_s=block_s, split_bytes=split_bytes, ahead_s=ahead_s).load(root)
