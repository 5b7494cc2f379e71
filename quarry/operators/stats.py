"""Statistics and profiles of columns over the current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import as_measure
from quarry.operators.binning import Bins, condense, date_bins, nice_bins
from quarry.operators.quantiles import quantiles
from quarry.plans.meta import ColumnMeta, Dataset

STATS_SCHEMA = (
    "count bigint, nulls bigint, distinct bigint, min double, max double, mean double, sum double, stdev double, "
    "p25 double, p50 double, p75 double, p95 double, outliers bigint"
)
DISTINCT_CAP, TOP_VALUES, SPARK_BINS, SPARK_CATEGORIES = 100_000, 20, 24, 100
QUARTILES = (0.25, 0.5, 0.75, 0.95)


def _distinct(c: Column) -> Column:
    """Distinct values, or -1 beyond the cap."""
    n = F.count_distinct(c)
    return F.when(n > DISTINCT_CAP, F.lit(-1)).otherwise(n).cast("bigint")


def quantitative_stats(ds: Dataset, rows: DataFrame, column: str) -> DataFrame:
    """One row: count, nulls, distinct, min, max, mean, sum, stdev (sample; 0 for one value), p25, p50, p75, p95, outliers.

    Dates are in milliseconds. Outliers lie strictly beyond 1.5 interquartile ranges. Without values all but counts and sum
    are null. Spread is computed about the least value, so large offsets cost no digits.
    """
    meta = ds.meta.column(column)
    v = rows.select(as_measure(F.col(f"`{column}`"), meta.kind).alias("v"))
    one = v.agg(
        F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("nulls"), _distinct(F.col("v")).alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.stddev_samp("v").alias("sd"),
    )
    facts = one.first()
    found = quantiles(v, [], "v", QUARTILES).first() if facts["count"] else None
    q = list(found) if found else [None] * 4
    outliers = 0
    if facts["count"]:
        reach = 1.5 * (q[2] - q[0])
        outliers = v.filter((F.col("v") < q[0] - reach) | (F.col("v") > q[2] + reach)).count()
    sd = (facts["sd"] or 0.0) if facts["count"] else None
    data = [(facts["count"], facts["nulls"], facts["distinct"], facts["min"], facts["max"], facts["mean"], facts["sum"], sd, *q, outliers)]
    return rows.sparkSession.createDataFrame(data, STATS_SCHEMA)


def categorical_stats(ds: Dataset, rows: DataFrame, column: str) -> DataFrame:
    """One row: count, nulls, distinct, min_len, max_len, avg_len, empties."""
    c = F.col(f"`{column}`") if ds.meta.column(column) else F.lit(None).cast("string")
    n = F.length(c)
    return rows.agg(
        F.count(c).alias("count"), F.count_if(c.isNull()).alias("nulls"), _distinct(c).alias("distinct"), F.coalesce(F.min(n), F.lit(0)).cast("bigint").alias("min_len"),
        F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_len"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_len"), F.count_if(c == "").alias("empties"),
    )


def top_values(ds: Dataset, rows: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    """(value, count) of the most frequent texts; of equal ones the first seen."""
    c = F.col(f"`{column}`")
    counted = rows.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(Dataset.RID).alias("__first"))
    return counted.orderBy(F.col("count").desc(), F.col("__first").asc()).limit(top).drop("__first")


def bool_stats(ds: Dataset, rows: DataFrame, column: str) -> DataFrame:
    """One row: count, nulls, trues, falses."""
    c = F.col(f"`{column}`")
    return rows.agg(F.count(c).alias("count"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c).alias("trues"), F.count_if(~c).alias("falses"))


def stats(ds: Dataset, rows: DataFrame, column: str) -> DataFrame:
    """The statistics of the column's kind; those of an unknown column are an empty text column's."""
    meta = ds.meta.column(column)
    if meta is None:
        return categorical_stats(ds, rows.limit(0), column)
    if meta.quantitative:
        return quantitative_stats(ds, rows, column)
    return bool_stats(ds, rows, column) if meta.kind == "bool" else categorical_stats(ds, rows, column)


def bins_of(meta: ColumnMeta, low: float | None, high: float | None, target: float) -> Bins:
    return date_bins(low, high, target) if meta.kind == "date" else nice_bins(low, high, target)


def bin_index(v: Column, bins: Bins) -> Column:
    """The bin of a value; the last one takes what lies at or beyond its end."""
    index = F.least(F.greatest(F.floor((v - F.lit(float(bins.start))) / F.lit(float(bins.width))).cast("bigint"), F.lit(0).cast("bigint")), F.lit(bins.count - 1).cast("bigint"))
    return F.when(v.isNotNull(), index)  # least and greatest pass over nulls


def measured(ds: Dataset, rows: DataFrame, column: str) -> DataFrame:
    """Non-null values of a quantitative column as doubles, in v."""
    meta = ds.meta.column(column)
    return rows.select(as_measure(F.col(f"`{column}`"), meta.kind).alias("v")).filter("v IS NOT NULL")


def histogram(ds: Dataset, rows: DataFrame, column: str, target: float = 30) -> DataFrame:
    """(bin_start, bin_end, count) of every bin, empty ones too; nothing without values."""
    meta = ds.meta.column(column)
    spark = rows.sparkSession
    if meta is None or not meta.quantitative:
        return spark.createDataFrame([], "bin_start double, bin_end double, count bigint")
    v = measured(ds, rows, column)
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if ends["a"] is None:
        return spark.createDataFrame([], "bin_start double, bin_end double, count bigint")
    bins = bins_of(meta, ends["a"], ends["b"], target)
    counted = v.groupBy(bin_index(F.col("v"), bins).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda i: F.lit(float(bins.start)) + i.cast("double") * F.lit(float(bins.width))
    every = spark.range(bins.count).withColumnRenamed("id", "i")
    return every.join(counted, "i", "left").select(edge(F.col("i")).alias("bin_start"), edge(F.col("i") + 1).alias("bin_end"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def profiles(ds: Dataset, rows: DataFrame, columns: list[str] | None = None, bins: int = SPARK_BINS) -> DataFrame:
    """(position, column_id, nulls, completeness, spark) of the asked columns, in their order; unknown ones are left out.

    spark holds counts: of false and true; of the most frequent texts if there are SPARK_CATEGORIES of them or fewer; of bins
    otherwise. One job counts nulls and extents of all columns, one bins all quantitative columns together, and one counts
    the texts of all columns that an estimate finds to have few.
    """
    wanted = [m for c in (columns if columns is not None else [c.id for c in ds.meta.columns]) if (m := ds.meta.column(c))]
    exprs = [F.count(F.lit(1)).alias("rows")]
    for k, m in enumerate(wanted):
        c = F.col(f"`{m.id}`")
        exprs.append(F.count(c).alias(f"n{k}"))
        if m.quantitative:
            v = as_measure(c, m.kind)
            exprs += [F.min(v).alias(f"a{k}"), F.max(v).alias(f"b{k}")]
        elif m.kind == "bool":
            exprs += [F.count_if(~c).alias(f"a{k}"), F.count_if(c).alias(f"b{k}")]
        elif m.distinct_count < 0:
            exprs.append(F.approx_count_distinct(c).alias(f"a{k}"))
    facts = rows.agg(*exprs).first()
    geometry = {k: bins_of(m, facts[f"a{k}"], facts[f"b{k}"], bins) for k, m in enumerate(wanted) if m.quantitative and facts[f"a{k}"] is not None}
    found: dict[int, list[float]] = {k: [float(facts[f"a{k}"]), float(facts[f"b{k}"])] for k, m in enumerate(wanted) if m.kind == "bool"}
    if geometry:
        marks = F.array(*[F.struct(F.lit(k).alias("k"), bin_index(as_measure(F.col(f"`{wanted[k].id}`"), wanted[k].kind), g).alias("i")) for k, g in geometry.items()])
        counted = rows.select(F.explode(marks).alias("m")).filter("m.i IS NOT NULL").groupBy("m.k", "m.i").count().collect()  # columns times 400 bins at most
        for k, g in geometry.items():
            full = [0.0] * g.count
            for r in counted:
                if r["k"] == k:
                    full[r["i"]] = float(r["count"])
            found[k] = condense(full, bins)
    few = [k for k, m in enumerate(wanted) if m.kind == "string" and 0 < (m.distinct_count if m.distinct_count >= 0 else facts[f"a{k}"] / 2) <= SPARK_CATEGORIES]
    if few:
        texts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{wanted[k].id}`").alias("t")) for k in few])
        counted = rows.select(F.explode(texts).alias("m")).filter("m.t IS NOT NULL").groupBy("m.k", "m.t").count().collect()  # a few hundred texts a column at most
        for k in few:
            sizes = sorted((float(r["count"]) for r in counted if r["k"] == k), reverse=True)
            if len(sizes) <= SPARK_CATEGORIES:
                found[k] = sizes[:bins]
    n = facts["rows"]
    data = [(k, m.id, n - facts[f"n{k}"], facts[f"n{k}"] / max(n, 1), found.get(k, [])) for k, m in enumerate(wanted)]
    return rows.sparkSession.createDataFrame(data, "position int, column_id string, nulls bigint, completeness double, spark array<double>")
