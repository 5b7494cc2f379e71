"""Groups with exact aggregates; nulls are a key of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import as_measure
from quarry.operators.quantiles import joined_by, quantiles
from quarry.plans.meta import Dataset
from quarry.plans.spec import Agg, Group, Sort

#: Distinct counts of groups stop here; part of what users see.
DISTINCT_CAP = 100_000


def aggregate(ds: Dataset, agg: Agg) -> Column:
    """count, nulls and distinct are whole numbers; the others are doubles, null without values."""
    meta = ds.meta.column(agg.column)
    if meta is None:
        return {"count": F.count(F.lit(1)), "nulls": F.lit(0).cast("bigint"), "distinct": F.lit(0).cast("bigint")}.get(agg.fn, F.lit(None).cast("double"))
    c = F.col(f"`{meta.id}`")
    if agg.fn == "count":
        return F.count(c)
    if agg.fn == "nulls":
        return F.count_if(c.isNull())
    if agg.fn == "distinct":
        return F.least(F.count_distinct(c), F.lit(DISTINCT_CAP).cast("bigint"))
    if agg.fn == "median":
        return F.lit(None).cast("double")  # joined afterwards (_with_medians)
    measure = as_measure(c, meta.kind)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg.fn](measure)


def _with_medians(ds: Dataset, rows: DataFrame, grouped: DataFrame, known: list[str], aggs: tuple[Agg, ...]) -> DataFrame:
    """The groups with their medians, which take ranks rather than one task's list of a group's values."""
    for a in aggs:
        meta = ds.meta.column(a.column)
        if a.fn == "median" and meta is not None:
            measure = rows.select(*[F.col(f"`{c}`").alias(f"key_{c}") for c in known], as_measure(F.col(f"`{meta.id}`"), meta.kind).alias("__measure"))
            keys = [f"key_{c}" for c in known]
            grouped = joined_by(grouped.drop(f"agg_{a.id}"), quantiles(measure, keys, "__measure", (0.5,)), keys, "q0", f"agg_{a.id}")
    return grouped


def group(ds: Dataset, rows: DataFrame, spec: Group) -> DataFrame:
    """key_<id> of each key, group_count and agg_<id> of each aggregate.

    Keys that the dataset doesn't have don't group, and read null; without any known key all rows are one group.
    No rows give no groups.
    """
    known = [c for c in spec.columns if ds.meta.column(c)]
    aggs = [aggregate(ds, a).alias(f"agg_{a.id}") for a in spec.aggs]
    grouped = rows.groupBy(*[F.col(f"`{c}`").alias(f"key_{c}") for c in known]).agg(F.count(F.lit(1)).alias("group_count"), *aggs)
    if not known:
        grouped = grouped.filter("group_count > 0")
    grouped = _with_medians(ds, rows, grouped, known, spec.aggs)
    keys = [F.col(f"`key_{c}`") if c in known else F.lit(None).cast("string").alias(f"key_{c}") for c in spec.columns]
    return grouped.select(*keys, "group_count", *[F.col(f"`agg_{a.id}`") for a in spec.aggs])


def with_first(ds: Dataset, rows: DataFrame, spec: Group) -> DataFrame:
    """group() with __first, the least __rid of each group, which breaks ties of order."""
    known = [c for c in spec.columns if ds.meta.column(c)]
    aggs = [aggregate(ds, a).alias(f"agg_{a.id}") for a in spec.aggs]
    grouped = rows.groupBy(*[F.col(f"`{c}`").alias(f"key_{c}") for c in known]).agg(F.count(F.lit(1)).alias("group_count"), *aggs, F.min(Dataset.RID).alias("__first"))
    grouped = _with_medians(ds, rows, grouped, known, spec.aggs)
    keys = [F.col(f"`key_{c}`") if c in known else F.lit(None).cast("string").alias(f"key_{c}") for c in spec.columns]
    return grouped.filter("group_count > 0").select(*keys, "group_count", *[F.col(f"`agg_{a.id}`") for a in spec.aggs], "__first")


def group_ordering(spec: Group, sorts: tuple[Sort, ...]) -> list[Column]:
    """A sort names a key, an aggregate's id, a column with an aggregate, or count; texts compare exactly; then by count
    downwards and by first row."""
    keys = []
    for s in sorts:
        by = next((a.id for a in spec.aggs if a.id == s.column), None) or next((a.id for a in spec.aggs if a.column == s.column), None)
        name = f"key_{s.column}" if s.column in spec.columns else f"agg_{by}" if by else "group_count" if s.column in ("count", "__count") else None
        if name:
            c = F.col(f"`{name}`")
            keys.append(c.desc_nulls_last() if s.descending else c.asc_nulls_last())
    return [*keys, F.col("group_count").desc(), F.col("__first").asc()]


def group_window(ds: Dataset, rows: DataFrame, spec: Group, sorts: tuple[Sort, ...] = (), offset: int = 0, limit: int = 2000) -> DataFrame:
    """A page of groups in order."""
    if not spec.columns:
        raise ValueError("the query doesn't group")
    ordered = with_first(ds, rows, spec).orderBy(*group_ordering(spec, sorts))
    return ordered.offset(max(0, int(offset))).limit(max(0, int(limit))).drop("__first")


def describe_columns(ds: Dataset, spec: Group) -> list[tuple[str, str, str]]:
    """(column, label, kind) of a grouped result."""
    name = lambda c: m.name if (m := ds.meta.column(c)) else c
    kind = lambda c: m.kind if (m := ds.meta.column(c)) else "string"
    keys = [(f"key_{c}", name(c), kind(c)) for c in spec.columns]
    aggs = [(f"agg_{a.id}", f"{a.fn} of {name(a.column)}", "int" if a.fn in ("count", "distinct", "nulls") else "float") for a in spec.aggs]
    return [*keys, ("group_count", "Rows", "int"), *aggs]


def default_aggregate(ds: Dataset, column: str) -> Agg:
    """What a new measure of a column is: its sum, or, where it can't be summed, its count."""
    meta = ds.meta.column(column)
    fn = "sum" if meta is not None and meta.kind in ("int", "float") else "count"
    return Agg(f"{fn}_{column}", fn, column)


def key_columns(ds: Dataset) -> list[str]:
    """Columns that are offered as keys: all but float ones."""
    return [c.id for c in ds.meta.columns if c.kind != "float"]


def key_warnings(ds: Dataset, spec: Group) -> list[str]:
    return [f"{c} is a float column; its groups may be many" for c in spec.columns if (m := ds.meta.column(c)) and m.kind == "float"]
