"""Declarative queries over one dataset: filters, search, sorts, groups, charts and saved views, with JSON round trips."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

QUANTITATIVE = ("int", "float", "date")

#: Filter operations by kind of column.
OPS = {
    "quantitative": ("eq", "ne", "gt", "gte", "lt", "lte", "between", "isNull", "notNull"),
    "bool": ("isTrue", "isFalse", "isNull", "notNull"),
    "string": ("eq", "ne", "contains", "notContains", "startsWith", "endsWith", "in", "notIn", "regex", "isEmpty", "isNull", "notNull"),
}
AGGREGATES = ("count", "sum", "avg", "min", "max", "median", "distinct", "nulls")
CHARTS = ("bar", "pie", "line", "histogram", "scatter")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None
    value2: Any = None
    values: tuple = ()
    case_sensitive: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class Search:
    term: str = ""
    columns: tuple[str, ...] | None = None
    case_sensitive: bool = False


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Agg:
    id: str
    fn: str
    column: str


@dataclass(frozen=True)
class Group:
    columns: tuple[str, ...] = ()
    aggs: tuple[Agg, ...] = ()


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    search: Search = Search()
    sorts: tuple[Sort, ...] = ()
    group: Group = Group()


@dataclass(frozen=True)
class Chart:
    kind: str
    x: str
    y: str | None = None
    fn: str = "count"
    bins: int = 0
    limit: int = 0
    series: str | None = None  # accepted and ignored: charts have one series


@dataclass(frozen=True)
class View:
    """A named query with its layout of columns and its charts."""

    id: str
    dataset_id: str
    name: str
    query: Query = Query()
    order: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    pinned: tuple[str, ...] = ()
    charts: tuple[Chart, ...] = ()
    created_at: int = 0


def to_json(spec) -> str:
    return json.dumps(dataclasses.asdict(spec), sort_keys=True, default=str)


def _tuple(kind, items) -> tuple:
    return tuple(kind(**x) for x in items or ())


def query_from(data: dict) -> Query:
    group = data.get("group") or {}
    search = data.get("search") or {}
    return Query(
        tuple(Filter(**(f | {"values": tuple(f.get("values") or ())})) for f in data.get("filters") or ()),
        Search(**(search | {"columns": None if search.get("columns") is None else tuple(search["columns"])})),
        _tuple(Sort, data.get("sorts")),
        Group(tuple(group.get("columns") or ()), _tuple(Agg, group.get("aggs"))),
    )


def view_from(text: str) -> View:
    data = json.loads(text)
    lists = {k: tuple(data.get(k) or ()) for k in ("order", "hidden", "pinned")}
    return View(**(data | lists | {"query": query_from(data.get("query") or {}), "charts": _tuple(Chart, data.get("charts"))}))


def toggle_sort(sorts: tuple[Sort, ...], column: str, additive: bool = False) -> tuple[Sort, ...]:
    """A column goes ascending, descending, off; additive keeps the other keys."""
    now = next((s for s in sorts if s.column == column), None)
    new = Sort(column) if now is None else Sort(column, True) if not now.descending else None
    if not additive:
        return (new,) if new else ()
    if now is None:
        return (*sorts, new)
    return tuple(x for x in (new if s is now else s for s in sorts) if x)


@dataclass(frozen=True)
class Layout:
    """Order of columns, hidden ones and pinned ones."""

    order: tuple[str, ...] = ()
    hidden: frozenset[str] = field(default_factory=frozenset)
    pinned: tuple[str, ...] = ()

    def visible(self) -> list[str]:
        """Shown columns: pinned ones first, each part in its order."""
        shown = [c for c in self.order if c not in self.hidden]
        return [c for c in shown if c in self.pinned] + [c for c in shown if c not in self.pinned]

    def hide(self, column: str) -> Layout:
        return dataclasses.replace(self, hidden=self.hidden | {column})

    def show(self, column: str) -> Layout:
        return dataclasses.replace(self, hidden=self.hidden - {column})

    def show_all(self) -> Layout:
        return dataclasses.replace(self, hidden=frozenset())

    def toggle_pin(self, column: str) -> Layout:
        pinned = tuple(c for c in self.pinned if c != column) if column in self.pinned else (*self.pinned, column)
        return dataclasses.replace(self, pinned=pinned)

    def move(self, column: str, before: str | None) -> Layout:
        """column to before another column, or to the end."""
        rest = [c for c in self.order if c != column]
        at = rest.index(before) if before in rest else len(rest)
        return dataclasses.replace(self, order=(*rest[:at], column, *rest[at:]))
