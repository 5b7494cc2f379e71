"""Filters and search as Spark predicates. A predicate of None is ignored; nulls match only isNull."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.plans.meta import ColumnMeta, Dataset
from quarry.plans.spec import Filter, Search

NONE = F.lit  # a predicate that no row meets is NONE(False)


def to_number(value) -> float | None:
    """An operand as a number: numbers, numeric texts, and ISO dates as milliseconds (UTC unless they say otherwise)."""
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, int | float):
        return None if value != value else float(value)
    if isinstance(value, dt.datetime):
        value = value if value.tzinfo else value.replace(tzinfo=dt.UTC)
        return value.timestamp() * 1000
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day, tzinfo=dt.UTC).timestamp() * 1000
    text = str(value if value is not None else "").strip()
    if not text:
        return None
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return float(text)
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        return float(int(text, 16))
    try:
        return to_number(dt.datetime.fromisoformat(text.replace("Z", "+00:00")))
    except ValueError:
        return None


def _literal(number: float, kind: str) -> Column:
    if kind == "date":
        return F.timestamp_millis(F.lit(int(number)).cast("bigint"))
    if kind == "int" and number == int(number) and abs(number) < 2**63:
        return F.lit(int(number)).cast("bigint")
    return F.lit(float(number))


def _quantitative(c: Column, kind: str, f: Filter) -> Column | None:
    if f.op == "between":
        low, high = sorted_bounds(to_number(f.value), to_number(f.value2))
        if low is None and high is None:
            return F.lit(False)
        parts = ([c >= _literal(low, kind)] if low is not None else []) + ([c <= _literal(high, kind)] if high is not None else [])
        return reduce(and_, parts)
    tests = {"eq": c.__eq__, "ne": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
    if f.op not in tests:
        return None
    number = to_number(f.value)
    return F.lit(False) if number is None else tests[f.op](_literal(number, kind))


def sorted_bounds(a: float | None, b: float | None) -> tuple[float | None, float | None]:
    return (b, a) if a is not None and b is not None and a > b else (a, b)


def _bool(c: Column, f: Filter) -> Column | None:
    if f.op in ("isTrue", "isFalse"):
        return c if f.op == "isTrue" else ~c
    if f.op in ("eq", "ne"):
        text = str(f.value).strip().lower()
        wanted = True if text in ("true", "t", "yes", "y", "1", "1.0") else False if text in ("false", "f", "no", "n", "0", "0.0") else None
        if wanted is None:
            return F.lit(False)
        return c == F.lit(wanted) if f.op == "eq" else c != F.lit(wanted)
    return None


def regex_is_sound(pattern: str) -> bool:
    """Whether Spark's regex dialect takes the pattern; no job runs, and nothing is raised."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:  # noqa: BLE001  any fault of the pattern
        return False
    return True


def _string(c: Column, f: Filter) -> Column | None:
    fold = (lambda x: x) if f.case_sensitive else F.lower
    text = "" if f.value is None else str(f.value)
    if f.op == "regex":
        pattern = text if f.case_sensitive else f"(?iu){text}"
        return c.rlike(pattern) if regex_is_sound(pattern) else F.lit(False)
    if f.op == "isEmpty":
        return c == ""
    if f.op in ("in", "notIn"):
        wanted = [fold(F.lit(str(v))) for v in f.values if v is not None]
        if not wanted:
            return F.lit(False) if f.op == "in" else c.isNotNull()
        found = fold(c).isin(*wanted)
        return found if f.op == "in" else ~found
    x, needle = fold(c), fold(F.lit(text))
    tests = {
        "eq": lambda: x == needle, "ne": lambda: x != needle, "contains": lambda: F.contains(x, needle), "notContains": lambda: ~F.contains(x, needle),
        "startsWith": lambda: F.startswith(x, needle), "endsWith": lambda: F.endswith(x, needle),
    }
    return tests[f.op]() if f.op in tests else None


def predicate(ds: Dataset, f: Filter) -> Column | None:
    """The predicate of a filter; None where it is off, its column isn't there or its kind doesn't have the operation."""
    meta = ds.meta.column(f.column)
    if meta is None or not f.enabled:
        return None
    c = F.col(f"`{meta.id}`")
    if f.op in ("isNull", "notNull"):
        return c.isNull() if f.op == "isNull" else c.isNotNull()
    if meta.quantitative:
        return _quantitative(c, meta.kind, f)
    return _bool(c, f) if meta.kind == "bool" else _string(c, f)


def _search_number(c: Column, term: str) -> Column | None:
    number = to_number(term) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", term) else None
    if number is None:
        return None
    same = c == F.lit(number)
    digits = term.strip()
    if not re.fullmatch(r"\d+", digits):
        return same
    if digits[0] == "0" and len(digits) > 1:
        # leading zeros: only the number itself can be cut to it
        return same | (F.floor(F.abs(c)) == F.lit(float(digits)))
    whole = F.floor(F.abs(c)).cast("decimal(38,0)").cast("string")
    return same | F.startswith(whole, F.lit(digits))


def _search_date(c: Column, term: str) -> Column | None:
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", term.strip())
    if not m:
        return None
    year, month, day = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    if not (1 <= month <= 12 and 1 <= day <= 31 and 1 <= year <= 9998):
        return None
    low = dt.datetime(year, month, 1, tzinfo=dt.UTC) + dt.timedelta(days=day - 1)
    if m[3]:
        high = low + dt.timedelta(days=1)
    elif m[2]:
        high = dt.datetime(year + month // 12, month % 12 + 1, 1, tzinfo=dt.UTC)
    else:
        high = dt.datetime(year + 1, 1, 1, tzinfo=dt.UTC)
    at = lambda t: F.timestamp_millis(F.lit(int(t.timestamp() * 1000)).cast("bigint"))
    return (c >= at(low)) & (c < at(high))


def _search_in(meta: ColumnMeta, search: Search) -> Column | None:
    c, term = F.col(f"`{meta.id}`"), search.term
    if meta.kind == "string":
        return F.contains(c, F.lit(term)) if search.case_sensitive else F.contains(F.lower(c), F.lower(F.lit(term)))
    if meta.kind == "bool":
        low = term.strip().lower()
        hits = [p for word, p in (("true", c), ("false", ~c)) if low and word.startswith(low)]
        return reduce(or_, hits) if hits else None
    return _search_date(c, term) if meta.kind == "date" else _search_number(c, term)


def search_predicate(ds: Dataset, search: Search) -> Column | None:
    """Rows with the term in any column of the scope; none if no column can hold it; all for an empty term."""
    if search.term == "":
        return None
    scope = ds.meta.columns if search.columns is None else [c for c in map(ds.meta.column, search.columns) if c]
    found = [p for p in (_search_in(c, search) for c in scope) if p is not None]
    return reduce(or_, found) if found else F.lit(False)


def condition(ds: Dataset, filters: tuple[Filter, ...], search: Search = Search()) -> Column | None:
    """All filters and the search together; None if nothing restricts the rows."""
    parts = [p for p in (*(predicate(ds, f) for f in filters), search_predicate(ds, search)) if p is not None]
    return reduce(and_, parts) if parts else None


def stored_condition(ds: Dataset, filters: tuple[Filter, ...]) -> Column | None:
    """What the filters on float columns say of the stored columns: implied by condition(), and pushed into scans."""
    parts = []
    for f in filters:
        meta = ds.meta.column(f.column)
        if meta is not None and f.enabled and meta.kind == "float" and meta.id in ds.raw and f.op not in ("isNull", "notNull", "ne"):
            p = _quantitative(F.col(ds.raw[meta.id]), "float", f)
            if p is not None:
                parts.append(p)
    return reduce(and_, parts) if parts else None
