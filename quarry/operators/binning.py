"""Bins with round edges for numbers and calendar units for dates; plain arithmetic on the driver."""

from __future__ import annotations

import math
from typing import NamedTuple

# Milliseconds of the units that date bins choose from.
SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
DATE_UNITS = (SECOND, 10 * SECOND, MINUTE, 5 * MINUTE, 15 * MINUTE, HOUR, 6 * HOUR, DAY, 7 * DAY, 30 * DAY, 91 * DAY, 365 * DAY)
MOST_BINS, MOST_TARGET, DEFAULT_TARGET = 400, 200, 30


class Bins(NamedTuple):
    start: float
    width: float
    count: int


def _target(wanted: float) -> int:
    rounded = math.floor(wanted + 0.5) if wanted == wanted and abs(wanted) != math.inf else 0
    return min(max(rounded or DEFAULT_TARGET, 1), MOST_TARGET)


def _finite(*values: float | None) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


def nice_bins(low: float | None, high: float | None, target: float = DEFAULT_TARGET) -> Bins:
    """Widths of 1, 2, 2.5, 5 or 10 times a power of ten, the least that gives no more bins than about the target."""
    if not _finite(low, high):
        return Bins(0, 1, 1)
    low, high = min(low, high), max(low, high)
    if low == high:
        return Bins(low - 0.5, 1, 1)
    raw = (high - low) / _target(target)
    power = 10.0 ** math.floor(math.log10(raw))
    width = next((m * power for m in (1, 2, 2.5, 5) if m * power >= raw), 10 * power)
    start = math.floor(low / width) * width
    return Bins(start, width, min(max(math.ceil((high - start) / width), 1), MOST_BINS))


def date_bins(low: float | None, high: float | None, target: float = DEFAULT_TARGET) -> Bins:
    """Milliseconds; the unit whose number of bins is nearest the target, the first of equal ones, from the epoch on."""
    if not _finite(low, high):
        return Bins(0, DAY, 1)
    low, high = min(low, high), max(low, high)
    if low == high:
        return Bins(low - DAY / 2, DAY, 1)
    wanted = _target(target)
    unit = min(DATE_UNITS, key=lambda u: abs((high - low) / u - wanted))
    start = math.floor(low / unit) * unit
    return Bins(start, unit, min(max(math.ceil((high - start) / unit), 1), MOST_BINS))


def condense(values: list[float], most: int = 24) -> list[float]:
    """Neighbours summed into at most so many buckets; the total stays."""
    if len(values) <= most:
        return list(values)
    out = [0.0] * most
    for k, v in enumerate(values):
        out[min(k * most // len(values), most - 1)] += v
    return out
