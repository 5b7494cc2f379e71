"""Order, pages and columns of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.meta import ColumnMeta, Dataset
from quarry.plans.spec import Sort

#: Rows of a page at most, and rows fetched beyond what is seen.
PAGE_ROWS, PAGE_PAD = 2000, 200


def sort_keys(meta: ColumnMeta, descending: bool) -> list[Column]:
    """Nulls last either way; texts without regard to case first, then exactly."""
    c = F.col(f"`{meta.id}`")
    keys = [F.lower(c), c] if meta.kind == "string" else [c]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def ordering(ds: Dataset, sorts: tuple[Sort, ...]) -> list[Column]:
    """Keys of the known sorts, then the source order."""
    keys = [k for s in sorts if (meta := ds.meta.column(s.column)) for k in sort_keys(meta, s.descending)]
    return [*keys, F.col(Dataset.RID).asc()]


def project(ds: Dataset, columns: list[str] | None) -> list[Column]:
    ids = [c.id for c in ds.meta.columns] if columns is None else [c for c in columns if ds.meta.column(c)]
    return [F.col(f"`{c}`") for c in ids]


def window(ds: Dataset, rows: DataFrame, sorts: tuple[Sort, ...] = (), offset: float = 0, limit: float = PAGE_ROWS, columns: list[str] | None = None) -> DataFrame:
    """A page of rows with __rid and the asked columns; unknown columns are dropped, and bounds are cut to whole numbers from 0."""
    offset, limit = max(0, int(offset // 1)), max(0, int(limit // 1))
    return rows.orderBy(*ordering(ds, sorts)).offset(offset).limit(limit).select(F.col(Dataset.RID), *project(ds, columns))


def page_bounds(first: int, last: int) -> tuple[int, int]:
    """Offset and limit to fetch for the rows first..last on the screen."""
    first = max(0, first)
    return first, min(max(last - first + PAGE_PAD, 1), PAGE_ROWS)
