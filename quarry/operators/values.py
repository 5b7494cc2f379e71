"""Distinct values of a column, and its extent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import as_measure, value_text
from quarry.plans.meta import Dataset


def distinct_values(ds: Dataset, rows: DataFrame, column: str, limit: int = 0, search: str = "") -> DataFrame:
    """(value, count): values as text, most frequent first, null last among equals and left out of a search; limit 0 is all."""
    meta = ds.meta.column(column)
    if meta is None:
        return rows.sparkSession.createDataFrame([], "value string, count bigint")
    counted = rows.groupBy(F.col(f"`{meta.id}`").alias("v")).agg(F.count(F.lit(1)).alias("count"))
    # values that print alike are one
    texts = counted.select(value_text(F.col("v"), meta.kind).alias("value"), "count")
    if meta.kind in ("float", "date"):
        texts = texts.groupBy("value").agg(F.sum("count").alias("count"))
    if search:
        texts = texts.filter(F.contains(F.lower("value"), F.lower(F.lit(search))))
    ranked = texts.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    return ranked.limit(limit) if limit > 0 else ranked


def extent(ds: Dataset, column: str) -> DataFrame:
    """(min, max) of a quantitative column over the whole dataset, dates in milliseconds; nulls otherwise."""
    meta = ds.meta.column(column)
    if meta is None or not meta.quantitative:
        return ds.df.sparkSession.createDataFrame([(None, None)], "min double, max double")
    c = F.col(f"`{meta.id}`")
    return ds.df.agg(F.min(c).alias("a"), F.max(c).alias("b")).select(as_measure(F.col("a"), meta.kind).alias("min"), as_measure(F.col("b"), meta.kind).alias("max"))
