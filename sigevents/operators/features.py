"""Numeric features of windows, vectorised in numpy over Arrow batches; each stays in its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

# Frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 80.0)}
GOOD, RATIO, DC, UNSTABLE, EMPTY = 0, 1, 2, 3, 4


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """To n samples through the spectrum, cut or padded; a shared Nyquist bin is halved or doubled."""
    m = len(x)
    if not m or n == m:
        return np.asarray(x, float)
    spectrum = np.fft.rfft(x)
    k = min(m, n)
    out = np.zeros(n // 2 + 1, complex)
    out[: k // 2 + 1] = spectrum[: k // 2 + 1]
    if k % 2 == 0:
        out[k // 2] *= 2 if n < m else 0.5
    return np.fft.irfft(out, n) * n / m


def interrupted(windows: np.ndarray) -> np.ndarray:
    """0 for each sound window of a stack (windows x channels x samples), else the reason it is not."""
    n, channels, samples = windows.shape
    step = samples // 10
    if not channels or not step:
        return np.full(n, RATIO if channels and samples and np.abs(windows).max() > 0 else EMPTY)
    peak = np.abs(windows).max(2)
    low = peak.min(1)
    ratio = (low <= 0) | (peak.max(1) > 50 * low)
    spread = windows[:, :, : step * 10].reshape(n, channels, 10, step).std(3).reshape(n, -1)
    return np.select([ratio, spread.min(1) < 1, spread.max(1) > 5000], [RATIO, DC, UNSTABLE], GOOD)


def log_spectrogram(windows: np.ndarray, fs: int = 250, taper: np.ndarray | None = None, keep_dc: bool = False) -> np.ndarray:
    """Frames of one second at half overlap of windows (..., channel, sample), as (..., time, channel, frequency): log10 magnitude, at least 0."""
    taper = np.sin(np.pi * (np.arange(fs) + 0.5) / fs) if taper is None else taper
    frames = np.lib.stride_tricks.sliding_window_view(windows, fs, axis=-1)[..., :: fs // 2, :]
    power = np.log10(np.abs(np.fft.rfft(frames * taper, axis=-1)) + 1e-6)
    return np.maximum(power if keep_dc else power[..., 1:], 0).swapaxes(-3, -2)


def fft_bins(x: np.ndarray, fs: int = 250, most: int = 47) -> np.ndarray:
    """Magnitudes of bins 1..most of consecutive whole seconds."""
    n = len(x) // fs
    return np.abs(np.fft.rfft(np.asarray(x, float)[: n * fs].reshape(n, fs), axis=1))[:, 1 : most + 1]


def welch(x: np.ndarray, fs: float, nperseg: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of signals (..., sample): periodic Hann, half overlap, means removed."""
    x = np.asarray(x, float)
    if x.shape[-1] < 2:
        return np.zeros(1), np.zeros((*x.shape[:-1], 1))
    n = nperseg or min(1 << int(np.ceil(np.log2(2 * fs))), 1 << int(np.log2(x.shape[-1])))
    n = min(n, x.shape[-1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)[..., :: max(1, n - n // 2), :]
    p = (np.abs(np.fft.rfft((frames - frames.mean(-1, keepdims=True)) * w, axis=-1)) ** 2).mean(-2) / (fs * (w**2).sum())
    p[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def _at(grid: np.ndarray, f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Densities (..., frequency) at the places of a grid, linear between frequencies."""
    i = np.clip(np.searchsorted(f, grid, "right") - 1, 0, max(0, len(f) - 2))
    j = np.minimum(i + 1, len(f) - 1)
    part = np.clip(np.divide(grid - f[i], f[j] - f[i], out=np.zeros(len(grid)), where=f[j] > f[i]), 0, 1)
    return p[..., i] + (p[..., j] - p[..., i]) * part


def band_powers(x: np.ndarray, fs: float, nperseg: int | None = None) -> dict[str, np.ndarray]:
    """Area under the density of signals (..., sample) in each band; band edges are interpolated."""
    f, p = welch(x, fs, nperseg)
    out = {}
    for name, (lo, hi) in BANDS.items():
        hi = min(hi, f[-1])
        grid = np.unique(np.r_[lo, f[(f > lo) & (f < hi)], hi]) if hi > lo else np.array([lo])
        out[name] = np.trapezoid(_at(grid, f, p), grid, axis=-1) if len(grid) > 1 else np.zeros(p.shape[:-1])
    return out


def stacks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and stack of the arrays of each shape in a column of arrays, or of arrays of arrays of one length; the batch's flat values are taken as they lie."""
    outer = column.offsets.to_numpy()
    if pa.types.is_list(column.type.value_type):
        inner = column.values.offsets.to_numpy()
        flat, rows = column.values.values.to_numpy(zero_copy_only=False), np.diff(outer)
        first = np.where(rows > 0, np.diff(inner)[np.minimum(outer[:-1], max(len(inner) - 2, 0))] if len(inner) > 1 else 0, 0)
        if (np.diff(inner)[outer[0] : outer[-1]] != first.repeat(rows)).any():
            raise ValueError("channels of a window differ in length")
        shapes, begins = np.stack([rows, first], 1), inner[outer[:-1]] if len(inner) > 1 else outer[:-1]
    else:
        flat, shapes, begins = column.values.to_numpy(zero_copy_only=False), np.diff(outer)[:, None], outer[:-1]
    for shape in np.unique(shapes, axis=0) if len(column) else ():
        at, size = np.flatnonzero((shapes == shape).all(1)), int(shape.prod())
        if len(at) == len(column):  # all of one shape: neighbours in the flat values
            yield at, flat[begins[0] : begins[0] + size * len(at)].reshape(len(at), *shape).astype(float)
        else:
            yield at, flat[begins[at][:, None] + np.arange(size)].reshape(len(at), *shape).astype(float)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """A column of numbers, or of arrays, which are laid flat."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind.value_type))


def _each(df: DataFrame, column: str, f: Callable, names: str) -> DataFrame:
    """Rows of ``df`` with what ``f`` makes of an array column instead of it. ``f`` gets all arrays of a batch that have one shape
    as a stack, and gives a list of values for each new column; small batches come from the session."""
    keys = [x for x in df.schema.fields if x.name != column]
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in keys] + [names])
    new = [c.split() for c in names.split(", ")]
    kinds = [to_arrow_type(_parse_datatype_string(t)) for _, t in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[list] = [[None] * batch.num_rows for _ in new]
            for at, stack in stacks(batch.column(column)):
                for into, got in zip(values, f(stack), strict=True):
                    for i, v in zip(at, got, strict=True):
                        into[i] = v
            made = [_column(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x.name) for x in keys), *made], names=[*(x.name for x in keys), *(n for n, _ in new)])

    return df.mapInArrow(run, schema)


def resample_signal(signals: DataFrame, fs: int, to: int = 250) -> DataFrame:
    return _each(signals, "samples", lambda x: ([resample(v, int(len(v) * to / fs)).astype(np.float32) for v in x],), "resampled array<float>")


def interrupted_flag(windows: DataFrame) -> DataFrame:
    return _each(windows, "samples", lambda x: (interrupted(x if x.ndim == 3 else x.reshape(len(x), 0, 0)).tolist(),), "reason int")


def stft_features(windows: DataFrame, fs: int = 250) -> DataFrame:
    def all_of(x: np.ndarray) -> tuple:
        s = log_spectrogram(x, fs)
        return list(s.reshape(len(s), -1)), *([n] * len(s) for n in s.shape[1:])

    return _each(windows, "samples", all_of, "spec array<double>, n_time int, n_ch int, n_freq int")


def fft_bin_table(blocks: DataFrame, fs: int = 250, most: int = 47) -> DataFrame:
    """Magnitudes of bins 1..most of each block's whole seconds, one after the other."""
    return _each(blocks, "samples", lambda x: ([fft_bins(v, fs, most).ravel() for v in x],), "bins array<double>")


def band_power_table(blocks: DataFrame, fs: float, nperseg: int | None = None) -> DataFrame:
    """Band powers of each block, and their shares of the total (0 where flat)."""
    names = list(BANDS)

    def all_of(x: np.ndarray) -> list[list]:
        got = band_powers(x, fs, nperseg)
        return [got[n].tolist() for n in names]

    out = _each(blocks, "samples", all_of, ", ".join(f"{n} double" for n in names))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return out.withColumns({f"{n}_ratio": F.when(total > 0, F.col(n) / total).otherwise(0.0) for n in names})


def score_stack(stack: np.ndarray, scorer: Callable, cleaner: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and skip codes of a stack of windows of one shape: 1 interrupted, 2 the cleaner gave none; a skipped window scores 0."""
    skip, prob = np.zeros(len(stack), np.int8), np.zeros(len(stack), np.float32)
    bad = interrupted(stack if stack.ndim == 3 else stack.reshape(len(stack), 0, 0)) != GOOD
    skip[bad] = 1
    at, fine = np.flatnonzero(~bad), stack[~bad]
    if cleaner:
        cleaned = [cleaner(w) for w in fine]
        kept = np.array([w is not None for w in cleaned], bool)
        skip[at[~kept]] = 2
        at, fine = at[kept], [w for w in cleaned if w is not None]
    if len(at):
        prob[at] = scorer(np.stack(fine))
    return prob, skip


def score_windows(windows: DataFrame, make_scorer: Callable[[], Callable], make_cleaner: Callable[[], Callable] | None = None) -> DataFrame:
    """recording_id, start_s, prob, skip_code: 1 interrupted, 2 the cleaner gave none, else the score.

    ``make_scorer`` and ``make_cleaner`` are called once for each task; the scorer gets a batch of windows.
    """
    kind = windows.schema["recording_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, cleaner = make_scorer(), make_cleaner() if make_cleaner else None
        for batch in batches:
            skip, prob = np.zeros(batch.num_rows, np.int8), np.zeros(batch.num_rows, np.float32)
            for at, stack in stacks(batch.column("samples")):
                prob[at], skip[at] = score_stack(stack, scorer, cleaner)
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("start_s"), pa.array(prob), pa.array(skip)], names=["recording_id", "start_s", "prob", "skip_code"])

    return windows.select("recording_id", F.col("start_s").cast("int").alias("start_s"), "samples").mapInArrow(run, f"recording_id {kind.simpleString()}, start_s int, prob float, skip_code byte")


def channel_importance(features: DataFrame, n_channels: int, trees: int = 300, seed: int = 0) -> DataFrame:
    """Random forest on (channel x frequency) features; importances summed over frequency, highest first."""
    rows = features.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    m = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows)
    sums = np.asarray(m.featureImportances.toArray()).reshape(n_channels, -1).sum(1)
    return features.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(sums)], "channel int, importance double").orderBy(F.desc("importance"))
