"""Chart-ready aggregates over the current rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.kinds import as_measure, value_text
from quarry.operators.quantiles import joined_by, quantiles
from quarry.operators.stats import bin_index, bins_of, histogram, measured
from quarry.plans.meta import ColumnMeta, Dataset, DatasetMeta
from quarry.plans.spec import Chart, Filter

#: Marks of a bar chart, bins of an axis, distinct values above which an axis is binned, points of a scatter chart.
LIMIT, AXIS_BINS, AXIS_VALUES, POINTS = 12, 40, 2000, 20_000
OTHER = "Other"


class ChartResult(NamedTuple):
    data: DataFrame
    label: str
    facts: dict  # truncated, total_categories, sampled, x_is_date, bin_width


def _empty(rows: DataFrame, schema: str, label: str) -> ChartResult:
    return ChartResult(rows.sparkSession.createDataFrame([], schema), label, {"truncated": False, "total_categories": 0, "sampled": 0, "x_is_date": False})


def label_of(ds: Dataset, chart: Chart) -> str:
    y = ds.meta.column(chart.y) if chart.y else None
    return f"{chart.fn} of {y.name}" if y else "rows"


def _mark(fn: str, y: ColumnMeta | None) -> Column:
    """The aggregate of a mark. A sum of nothing is 0; averages of nothing are null; only numbers and dates are measured."""
    if y is None or fn == "count":
        return F.count(F.lit(1)).cast("double")
    c = F.col("y")
    if not y.quantitative:
        return {"sum": F.lit(0.0), "nulls": F.lit(0.0), "distinct": F.lit(0.0)}.get(fn, F.lit(None).cast("double"))
    return {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)), "avg": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "median": lambda: F.lit(None).cast("double"),
        "nulls": lambda: F.count_if(c.isNull()).cast("double"), "distinct": lambda: F.count_distinct(c).cast("double"),
    }[fn]()


def _marks(rows: DataFrame, by: list[str], fn: str, y: ColumnMeta | None, *more: Column) -> DataFrame:
    """by, y and rows of each mark; medians are joined, as they take ranks rather than one task's list of values."""
    out = rows.groupBy(*by).agg(_mark(fn, y).alias("y"), F.count(F.lit(1)).alias("rows"), *more)
    if fn == "median" and y is not None and y.quantitative:
        out = joined_by(out.drop("y"), quantiles(rows, by, "y", (0.5,)), by, "q0", "y")
    return out


def chart(ds: Dataset, rows: DataFrame, spec: Chart) -> ChartResult:
    """The data of a chart: (x, y, rows) of bars, slices and lines; (bin_start, bin_end, count); or (x, y) of points.

    Rows of null x are left out. Bars and slices are ranked by y and cut at the limit; the rest is aggregated anew
    from its rows as Other. Lines over numbers and dates go by x. A chart that can't be has no rows.
    """
    label = label_of(ds, spec)
    x = ds.meta.column(spec.x)
    y = ds.meta.column(spec.y) if spec.y else None
    if spec.kind == "scatter":
        return _scatter(ds, rows, spec, label)
    if spec.kind == "histogram":
        if x is None or not x.quantitative:
            return _empty(rows, "bin_start double, bin_end double, count bigint", "rows")
        return ChartResult(histogram(ds, rows, spec.x, spec.bins or 30), "rows", {"x_is_date": x.kind == "date"})
    schema = "label string, x double, y double, rows bigint, position int"
    if x is None or (spec.y and y is None):
        return _empty(rows, schema, label)
    fn = spec.fn if spec.y else "count"
    ordered_line = spec.kind == "line" and x.quantitative
    c = F.col(f"`{x.id}`")
    measure = as_measure(F.col(f"`{y.id}`"), y.kind) if y else F.lit(None).cast("double")
    base = rows.filter(c.isNotNull())
    facts = {"x_is_date": x.kind == "date"}
    if x.quantitative:
        key, width = _axis(ds, rows, x, spec)
        if key is None:
            return _empty(rows, schema, label)
        if width is not None:
            facts["bin_width"] = width
        text = value_text(F.timestamp_millis(F.col("x").cast("bigint")), "date") if x.kind == "date" else value_text(F.col("x"), "float")
    else:
        key, text = F.lit(None).cast("double"), F.col("label")
    shown = value_text(c, x.kind) if not x.quantitative else F.lit(None).cast("string")
    marks = base.select(shown.alias("label"), key.alias("x"), measure.alias("y"), F.col(Dataset.RID).alias("__rid"))
    by = ["x"] if x.quantitative else ["label"]
    whole = _marks(marks, by, fn, y, F.min("__rid").alias("__first"))
    if ordered_line:
        data = whole.select(text.alias("label"), "x", "y", "rows").orderBy("x")
        return ChartResult(data, label, facts | {"truncated": False})
    limit = max(1, spec.limit or LIMIT)
    rank = F.struct(F.coalesce("y", F.lit(0.0)).alias("y"), (-F.col("__first")).alias("f"))
    # the marks that stay are a bounded set: the rest never leaves its partitions but for its total
    kept = whole.orderBy(rank.desc()).limit(limit)
    top = kept.withColumn("position", F.row_number().over(Window.orderBy(rank.desc())))  # limit rows
    keys = F.broadcast(kept.select(F.col(by[0]).alias("__key")))
    rest = marks.join(keys, marks[by[0]].eqNullSafe(F.col("__key")), "left_anti")
    other = _marks(rest, [], fn, y).filter("rows > 0")
    named = top.select((text if x.quantitative else F.col("label")).alias("label"), F.col("x") if x.quantitative else F.lit(None).cast("double").alias("x"), "y", "rows", "position")
    tail = other.select(F.lit(OTHER).alias("label"), F.lit(None).cast("double").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), "rows", F.lit(limit + 1).alias("position"))
    return ChartResult(named.unionByName(tail), label, facts)


def _axis(ds: Dataset, rows: DataFrame, x: ColumnMeta, spec: Chart) -> tuple[Column | None, float | None]:
    """What marks of a bar, pie or line chart are told by, and the width of its bins if it has any; none without values."""
    c = F.col(f"`{x.id}`")
    if not x.quantitative:
        return c, None
    v = as_measure(c, x.kind)
    if 0 <= x.distinct_count <= AXIS_VALUES:
        return v, None
    ends = measured(ds, rows, x.id).agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if ends["a"] is None:
        return None, None
    bins = bins_of(x, ends["a"], ends["b"], spec.bins or AXIS_BINS)
    return F.lit(float(bins.start)) + bin_index(v, bins).cast("double") * F.lit(float(bins.width)), bins.width


def facts_of(ds: Dataset, rows: DataFrame, spec: Chart) -> dict:
    """total_categories, truncated and sampled (rows that reach a mark) of a bar, pie or line chart."""
    x = ds.meta.column(spec.x)
    if x is None:
        return {"total_categories": 0, "truncated": False, "sampled": 0}
    # marks: the bins of a binned axis, else the values
    key, _ = _axis(ds, rows, x, spec)
    if key is None:
        return {"total_categories": 0, "truncated": False, "sampled": 0}
    r = rows.agg(F.count_distinct(key).alias("k"), F.count(key).alias("n")).first()
    return {"total_categories": r["k"], "truncated": r["k"] > max(1, spec.limit or LIMIT) and not (spec.kind == "line" and x.quantitative), "sampled": r["n"]}


def _scatter(ds: Dataset, rows: DataFrame, spec: Chart, label: str) -> ChartResult:
    """Pairs of numbers. Above the most points, every k-th of the rows in source order; pairs with a null are left out."""
    x, y = ds.meta.column(spec.x), ds.meta.column(spec.y) if spec.y else None
    if x is None or y is None or not x.quantitative or not y.quantitative:
        return _empty(rows, "x double, y double", label)
    n = rows.count()
    stride = -(-n // POINTS)
    pair = [as_measure(F.col(f"`{x.id}`"), x.kind).alias("x"), as_measure(F.col(f"`{y.id}`"), y.kind).alias("y")]
    if stride <= 1:
        return ChartResult(rows.select(*pair).dropna(), label, {"truncated": False, "x_is_date": x.kind == "date"})
    # positions in source order from counts of ranges of row ids, not from one sorted partition; kept, as both passes
    # must see the same ranges
    placed = rows.select(Dataset.RID, *pair).repartitionByRange(Dataset.RID).sortWithinPartitions(Dataset.RID).withColumn("__part", F.spark_partition_id()).persist()
    counts = placed.groupBy("__part").count().collect()  # one row a partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["__part"]):
        before[r["__part"]] = total
        total += r["count"]
    offsets = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])
    within = F.row_number().over(Window.partitionBy("__part").orderBy(Dataset.RID)) - 1
    position = offsets[F.col("__part")] + within
    picked = placed.withColumn("__at", position).filter(F.pmod("__at", F.lit(stride)) == 0).select("x", "y").dropna()
    return ChartResult(picked, label, {"truncated": True, "x_is_date": x.kind == "date"})


def default_chart(meta: DatasetMeta) -> Chart | None:
    """Bars of the text or boolean column with the fewest values (2 to 50), else a histogram of the first numeric column."""
    few = [c for c in meta.columns if c.kind in ("string", "bool") and 2 <= c.distinct_count <= 50]
    if few:
        return Chart("bar", min(few, key=lambda c: c.distinct_count).id)
    number = next((c for c in meta.columns if c.quantitative), None)
    return Chart("histogram", number.id) if number else None


def filter_of_mark(ds: Dataset, spec: Chart, label: str, x: float | None = None) -> Filter | None:
    """The filter that a click on a mark adds; none for Other."""
    meta = ds.meta.column(spec.x)
    if meta is None or (label == OTHER and x is None):
        return None
    return Filter(spec.x, "eq", x if meta.quantitative and x is not None else label)
