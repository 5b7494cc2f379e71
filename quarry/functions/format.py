"""Numbers, sizes, times and dates for display."""

from __future__ import annotations

import datetime as dt


def number(value: float | None, digits: int = 2) -> str:
    """Grouped by thousands, without trailing zeros."""
    if value is None or value != value:
        return "–"
    text = f"{value:,.{digits}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def size(n: float) -> str:
    units = ("B", "KB", "MB", "GB", "TB")
    at = 0
    while abs(n) >= 1024 and at < len(units) - 1:
        n, at = n / 1024, at + 1
    return f"{n:.0f} {units[at]}" if at == 0 else f"{n:.1f} {units[at]}"


def duration(ms: float) -> str:
    if ms < 1000:
        return f"{ms:.0f} ms"
    if ms < 60_000:
        return f"{ms / 1000:.1f} s"
    return f"{int(ms // 60_000)} m {int(ms % 60_000 // 1000)} s"


def date(ms: float | None) -> str:
    """A day, with the time unless it is midnight in UTC."""
    if ms is None:
        return "–"
    t = dt.datetime.fromtimestamp(ms / 1000, dt.UTC)
    return t.strftime("%Y-%m-%d") if ms % 86_400_000 == 0 else t.strftime("%Y-%m-%d %H:%M:%S")
