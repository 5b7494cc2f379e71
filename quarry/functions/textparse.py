"""Text to values: null tokens, numbers, dates and booleans, as expressions over a string column."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammars and tokens of the accepted texts.
NULL_TOKENS = ("null", "nil", "na", "n/a", "nan", "none", "-")
TRUE_TOKENS, FALSE_TOKENS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
BLANK = r"^[\x00-\x20]*\z"
NUMBER = (
    r"^[\x00-\x20]*(?:-(?:[$£¥€][\x00-\x20]*)?|\+?(?:[$£¥€][\x00-\x20]*[+-]?)?)(?=\.?\d)"
    r"(?:\d{1,3}(?:,\d{3})+|\d*)(?:\.\d*)?(?:[eE][+-]?\d+)?(?:[\x00-\x20]*%)?[\x00-\x20]*\z"
)
DATE = (
    r"^(?:(\d{4})([-/])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/])(\d{1,2})\6(\d{4}))"
    r"(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?([Zz]|[+-]\d{2}(?::?\d{2})?)?)?\z"
)


def is_null_token(s: Column, extra: Iterable[str] = ()) -> Column:
    """Blank, a null token in any case, or one of extra as given, in lower or in upper case."""
    also = sorted({v for e in extra for v in (e, e.lower(), e.upper())})
    found = s.isNull() | s.rlike(BLANK) | F.lower(s).isin(*NULL_TOKENS)
    return found | s.isin(*also) if also else found


def is_number(s: Column) -> Column:
    return s.rlike(NUMBER)


def number(s: Column) -> Column:
    """Its value without currency, groups and percent sign (not divided), else null."""
    bare = F.regexp_replace(s, r"[\x00-\x20$£¥€,%]", "")
    return F.when(is_number(s), bare.try_cast("double"))


def has_currency(s: Column) -> Column:
    return s.rlike("[$£¥€]")


def has_percent(s: Column) -> Column:
    return s.contains("%")


def has_groups(s: Column) -> Column:
    return s.contains(",")


def is_whole(s: Column) -> Column:
    return is_number(s) & ~s.rlike("[.eE]")


def _part(s: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(s, DATE, k), F.lit(""))


def date_shape(s: Column) -> Column:
    """iso, slash (two short numbers first) or null."""
    fits = s.rlike(DATE) & F.length(s).between(6, 40)
    return F.when(fits & _part(s, 1).isNotNull(), "iso").when(fits, "slash")


def first_short(s: Column) -> Column:
    return _part(s, 5).try_cast("int")


def second_short(s: Column) -> Column:
    return _part(s, 7).try_cast("int")


def date(s: Column, order: str = "mdy") -> Column:
    """A timestamp in UTC of year-month-day texts, or of two short numbers and a year in this order, else the other one.

    Times may have seconds, a fraction cut to milliseconds, and a zone of up to 14 hours; none is UTC.
    """
    iso = _part(s, 1).isNotNull()
    year = F.coalesce(_part(s, 1), _part(s, 8)).try_cast("int")
    hour, minute = (F.coalesce(_part(s, k).try_cast("int"), F.lit(0)) for k in (9, 10))
    second = F.coalesce(_part(s, 11).try_cast("int"), F.lit(0))
    millis = F.coalesce(F.rpad(F.substring(_part(s, 12), 1, 3), 3, "0").try_cast("int"), F.lit(0))
    zone = _part(s, 13)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    zone_hours, zone_minutes = (F.coalesce(F.substring(digits, k, 2).try_cast("int"), F.lit(0)) for k in (1, 3))
    off = F.when(zone.startswith("-"), -1).otherwise(1) * (zone_hours * 60 + zone_minutes)
    sound = F.length(s).between(6, 40) & s.rlike(DATE) & (hour <= 23) & (minute <= 59) & (second <= 60) & ((zone_hours * 60 + zone_minutes) <= 14 * 60) & (zone_minutes <= 59)

    def day(month: Column, of_month: Column) -> Column:
        return F.try_make_timestamp(year, month, of_month, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC"))

    n1, n2 = first_short(s), second_short(s)
    mdy, dmy = day(n1, n2), day(n2, n1)
    start = F.when(iso, day(_part(s, 3).try_cast("int"), _part(s, 4).try_cast("int"))).otherwise(F.coalesce(dmy, mdy) if order == "dmy" else F.coalesce(mdy, dmy))
    of_day = ((hour * 60 + minute - F.coalesce(off, F.lit(0))) * 60 + second).cast("bigint") * 1000 + millis
    return F.when(sound, F.timestamp_millis(F.unix_millis(start) + of_day))


def is_bool(s: Column) -> Column:
    return F.lower(s).isin(*TRUE_TOKENS, *FALSE_TOKENS)


def boolean(s: Column) -> Column:
    return F.when(F.lower(s).isin(*TRUE_TOKENS), True).when(F.lower(s).isin(*FALSE_TOKENS), False)


def flag_header(name: str) -> bool:
    low = name.lower()
    return bool(re.match(r"(is|has)_", low)) or "_flag" in low or low.endswith("flag") or bool(re.match(r"(is|has)[A-Z]", name))


def date_header(name: str) -> bool:
    low = name.lower()
    return "date" in low or "time" in low or low.endswith(("_at", "_ts")) or "_at_" in low or "_ts_" in low or low in ("ts", "at")
