"""From blocks of samples to scored windows in one stage.

A task streams through the blocks of a recording in order. It keeps the blocks that a window not yet scored
still needs, cuts windows, checks them, transforms and scores them in stacks of a few, and lets the samples
go: nothing but scores leaves the task, and samples are shuffled once at most, or not at all

* where blocks come from ranges of files that hold what windows need beyond their end (``read_edf_ranges``
  with ``ahead_s``): each range is scored where it is read, so a long recording is scored by many tasks;
* where the table of signals is bucketed by recording (``write_signals``).

Windows begin at 0, step, ... while they end within the recording. A window that lacks samples of any of
the channels (a block is missing, or a channel in it) has skip_code 3 and the score 0; where several blocks
have the same samples, the first counts. Signals of another rate than ``fs`` are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigevents.operators.features import score_stack

SHORT = 3


class Cutter:
    """Windows of one recording from its blocks in order of time."""

    def __init__(self, channels: int, seg: int, step: int, fs: int) -> None:
        self.channels, self.n, self.step, self.fs = channels, seg * fs, step, fs
        self.held: list[tuple[int, np.ndarray]] = []  # where blocks begin, and their samples (channel, time)
        self.next: int | None = None  # start of the next window, in seconds
        self.end: int | None = None  # samples that other tasks' windows begin at
        self.known = 0  # samples up to which the recording is known

    def _start(self, begin: int) -> None:
        if self.next is None:
            self.next = -(-begin // (self.step * self.fs)) * self.step

    def block(self, begin: int, samples: np.ndarray | None, length: int, ahead: bool) -> Iterator[tuple[int, np.ndarray | None]]:
        """Take a block (no samples: it lacks a channel), and give the windows that end in it."""
        self._start(begin)
        if ahead and self.end is None:
            self.end = begin
        self.known = max(self.known, begin + length)
        if samples is not None:
            self.held.append((begin, samples))
        while self.next * self.fs + self.n <= self.known and (self.end is None or self.next * self.fs < self.end):
            yield self.next, self._window(self.next * self.fs)
            self.next += self.step
        first = self.next * self.fs
        self.held = [(b, x) for b, x in self.held if b + x.shape[1] > first]

    def _window(self, begin: int) -> np.ndarray | None:
        parts, at = [], begin
        for b, x in self.held:
            if b <= at < b + x.shape[1] and at < begin + self.n:
                parts.append(x[:, at - b : begin + self.n - b])
                at += parts[-1].shape[1]
        return np.concatenate(parts, 1) if at >= begin + self.n else None


class _Stacks:
    """Windows waiting to be scored, and rows of scores."""

    def __init__(self, scorer: Callable, cleaner: Callable | None, transform: Callable | None, most: int) -> None:
        self.scorer = scorer if transform is None else lambda x: scorer(transform(x))
        self.cleaner, self.most = cleaner, most
        self.waiting: list[tuple] = []

    def add(self, recording, start: int, window: np.ndarray | None) -> bool:
        self.waiting.append((recording, start, window))
        return len(self.waiting) >= self.most

    def scored(self) -> tuple[list, ...]:
        prob, skip = np.zeros(len(self.waiting), np.float32), np.full(len(self.waiting), SHORT, np.int8)
        whole = [i for i, w in enumerate(self.waiting) if w[2] is not None]
        if whole:
            prob[whole], skip[whole] = score_stack(np.stack([self.waiting[i][2] for i in whole]).astype(float), self.scorer, self.cleaner)
        out = [w[0] for w in self.waiting], [w[1] for w in self.waiting], prob, skip
        self.waiting = []
        return out


def _blocks(batches: Iterator[pa.RecordBatch], channels: Sequence[str], fs: int) -> Iterator[tuple]:
    """recording, first sample, samples of all channels or None, length, ahead, of each block of some rows that follow each other."""
    order = {c: i for i, c in enumerate(channels)}
    key, rows = None, {}

    def whole() -> tuple:
        recording, begin, ahead = key[0], round(key[2] * fs), key[3]
        length = max(map(len, rows.values()))
        found = [rows.get(i) for i in range(len(order))]
        return recording, begin, None if any(x is None or len(x) < length for x in found) else np.stack(found), length, ahead

    for batch in batches:
        samples = batch.column("samples")
        ends, flat = samples.offsets.to_numpy(), samples.values.to_numpy(zero_copy_only=False)
        ahead = batch.column("ahead").to_pylist() if "ahead" in batch.schema.names else [False] * batch.num_rows
        for i, (recording, channel, block, start, rate) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("recording_id", "channel", "block_idx", "start_s", "fs")), strict=True)):
            if channel in order and rate != fs:
                raise ValueError(f"{recording}, {channel}: {rate} samples a second, not {fs}")
            now = (recording, block, start, ahead[i])
            if key is not None and now != key:
                yield whole()
                rows = {}
            key = now
            x = flat[ends[i] : ends[i + 1]]
            rows.setdefault(order.get(channel, -1), np.array(x))  # a copy: the batch can go
    if key is not None:
        yield whole()


def score_recordings(signals: DataFrame, channels: Sequence[str], make_scorer: Callable[[], Callable], seg: int = 12, step: int = 6, fs: int = 250, make_cleaner: Callable[[], Callable] | None = None, transform: Callable[[np.ndarray], np.ndarray] | None = None, layout: str = "any", stack: int = 32) -> DataFrame:
    """recording_id, start_s, prob, skip_code of all windows of a table of signal blocks.

    ``layout``: ``ranges`` if partitions are ranges of recordings in order with ``ahead`` rows for ``seg``
    seconds; ``bucketed`` if the table is bucketed by recording_id; ``any`` deals blocks by recording first.
    ``transform`` (such as ``features.log_spectrogram``) is put between a stack of windows and the scorer.
    """
    kind = signals.schema["recording_id"].dataType
    arrow = [to_arrow_type(kind), pa.int32(), pa.float32(), pa.int8()]
    channels = list(channels)

    made: list[_Stacks] = []  # by each task once, whatever many recordings it has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_Stacks(make_scorer(), make_cleaner() if make_cleaner else None, transform, stack))
        stacks = made[0]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(stacks.scored(), arrow, strict=True)], names=["recording_id", "start_s", "prob", "skip_code"])
        last, cutter = None, None
        for recording, begin, samples, length, ahead in _blocks(batches, channels, fs):
            if cutter is None or recording != last or (not ahead and cutter.end is not None):
                last, cutter = recording, Cutter(len(channels), seg, step, fs)
                if layout != "ranges":
                    cutter._start(0)
            for start, window in cutter.block(begin, samples, length, ahead):
                if stacks.add(recording, start, window):
                    yield batch()
        if stacks.waiting:
            yield batch()

    columns = ["recording_id", "channel", "block_idx", "start_s", "fs", F.col("samples").cast("array<float>").alias("samples")]
    schema = f"recording_id {kind.simpleString()}, start_s int, prob float, skip_code byte"
    if layout == "ranges":
        return signals.select(*columns, "ahead").mapInArrow(run, schema)
    if layout == "any":
        signals = signals.repartition("recording_id")
    # dealt by recording already, so that grouping adds no shuffle, and sorted by it, so that it keeps this order
    ordered = signals.select(*columns).sortWithinPartitions("recording_id", "block_idx", "start_s")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return ordered.groupBy("recording_id").applyInArrow(one, schema)


def write_signals(signals: DataFrame, table: str, buckets: int) -> None:
    """A table of signals bucketed by recording and sorted by block, which ``score_recordings`` reads without a shuffle."""
    signals.write.bucketBy(buckets, "recording_id").sortBy("recording_id", "block_idx").mode("overwrite").saveAsTable(table)
