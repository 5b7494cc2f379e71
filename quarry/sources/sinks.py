"""Rows as CSV: lines that are built as expressions and written by Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import value_text
from quarry.plans.meta import Dataset
from quarry.plans.spec import Layout

#: Rows that the export of a view writes at most.
VIEW_ROWS = 1_000_000


def field(text: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text), F.lit(""))


def header(ds: Dataset, columns: list[str] | None = None) -> str:
    names = [c.name for c in ds.meta.columns] if columns is None else [m.name for c in columns if (m := ds.meta.column(c))]
    return ",".join('"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\r\n') else n for n in names)


def csv_lines(ds: Dataset, rows: DataFrame, columns: list[str] | None = None, limit: int = 0) -> DataFrame:
    """One line a row, without line ends; unknown columns are left out, and limit 0 is all."""
    known = [c for c in ds.meta.columns] if columns is None else [m for c in columns if (m := ds.meta.column(c))]
    fields = [field(value_text(F.col(f"`{m.id}`"), m.kind)) for m in known]
    lines = rows.select(F.concat_ws(",", *fields).alias("line"))
    return lines.limit(limit) if limit > 0 else lines


def write_csv(ds: Dataset, rows: DataFrame, path: str, columns: list[str] | None = None, limit: int = 0) -> None:
    """A folder of part files with CRLF line ends that are one CSV file in their order: the first holds the header."""
    lines = csv_lines(ds, rows, columns, limit)
    head = rows.sparkSession.createDataFrame([(header(ds, columns),)], lines.schema).coalesce(1)
    head.union(lines).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def csv_bytes(ds: Dataset, rows: DataFrame, columns: list[str] | None = None, limit: int = 0) -> bytes:
    """A small export as one string of bytes, rows streamed partition by partition."""
    out = [header(ds, columns), *(r["line"] for r in csv_lines(ds, rows, columns, limit).toLocalIterator())]
    return "".join(f"{line}\r\n" for line in out).encode()


def view_columns(layout: Layout) -> list[str]:
    """A view exports its visible columns as they stand, and rows rather than groups."""
    return layout.visible()


def view_limit(matched: int) -> int:
    """Rows that the export of a view writes."""
    return min(matched, VIEW_ROWS)


def exported_rows(matched: int, limit: int = 0) -> int:
    return min(limit, matched) if limit > 0 else matched
