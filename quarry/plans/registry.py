"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.engine import filtered
from quarry.plans.meta import Dataset
from quarry.plans.spec import Filter, Query, Search
from quarry.sources import adopt

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Dataset:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return adopt.adopt(df.selectExpr(*columns) if columns else df, name)


def at(ds: Dataset, *filters: Filter, search: Search = Search()) -> DataFrame:
    return filtered(ds, Query(filters, search))
