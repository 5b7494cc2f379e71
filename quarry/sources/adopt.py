"""Typed tables as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import kind_of, normalised
from quarry.plans.meta import ColumnMeta, Dataset, DatasetMeta, column_ids, dataset_id, now_ms

#: Numbers above so many rows, and texts above so many values, have no known count of distinct values.
NUMERIC_ROWS, DISTINCT_CAP = 10_000, 65_536


def adopt(df: DataFrame, name: str = "table") -> Dataset:
    """A frame as a dataset: columns by their ids in their kinds' types; lazy, so that scans see filters and columns."""
    ids = column_ids(df.columns)
    fields = list(zip(ids, df.schema.fields, strict=True))
    raw = {i: f"__raw_{i}" for i, f in fields if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    quoted = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    columns = [normalised(quoted(f), f.dataType).alias(i) for i, f in fields] + [quoted(f).alias(raw[i]) for i, f in fields if i in raw]
    meta = tuple(ColumnMeta(i, f.name, k, kind_of(f.dataType)) for k, (i, f) in enumerate(fields))
    created = now_ms()
    return Dataset(df.select(*columns), DatasetMeta(dataset_id(name, -1, created), name, meta, created_at=created), raw=raw)


def read_parquet(spark, path: str, name: str | None = None) -> Dataset:
    return adopt(spark.read.parquet(path), name or path.rstrip("/").rsplit("/", 1)[-1])


def with_counts(ds: Dataset) -> Dataset:
    """The dataset with counts of rows, nulls and distinct values, from one job."""
    from dataclasses import replace

    exprs = [F.count(F.lit(1)).alias("rows")]
    for k, c in enumerate(ds.meta.columns):
        exprs += [F.count(F.col(f"`{c.id}`")).alias(f"n{k}"), F.approx_count_distinct(F.col(f"`{c.id}`")).alias(f"a{k}")]
    row = ds.df.agg(*exprs).first()
    # exact counts only for columns whose estimate leaves the answer open
    unsure = [k for k, c in enumerate(ds.meta.columns) if not (c.quantitative and row[f"n{k}"] >= NUMERIC_ROWS) and row[f"a{k}"] <= 2 * DISTINCT_CAP]
    exact = ds.df.agg(*[F.count_distinct(F.col(f"`{ds.meta.columns[k].id}`")).alias(f"d{k}") for k in unsure]).first() if unsure else {}
    columns = []
    for k, c in enumerate(ds.meta.columns):
        distinct = exact[f"d{k}"] if k in unsure else -1
        if c.quantitative and distinct > DISTINCT_CAP:
            distinct = -1
        columns.append(replace(c, null_count=row["rows"] - row[f"n{k}"], distinct_count=distinct))
    return replace(ds, meta=replace(ds.meta, columns=tuple(columns), row_count=row["rows"]))
