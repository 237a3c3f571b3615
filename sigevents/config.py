"""The operating point, passed explicitly to every job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class OperatingPoint:
    # Seconds of a window and between windows, sampling rate, decision and shaping rules.
    seg: int = 12
    step: int = 6
    fs: int = 250
    threshold: float = 0.5
    tolerance: float = 5.0
    min_duration: float = 5.0
    merge_gap: float = 10.0
    grid: tuple[float, ...] = (0.5, 0.3, 0.1, 0.05, 0.01)


DEFAULT = OperatingPoint()
