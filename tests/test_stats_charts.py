import math

import pytest

from quarry.operators import charts, stats
from quarry.operators.binning import DAY, HOUR, condense, date_bins, nice_bins
from quarry.plans.engine import filtered
from quarry.plans.meta import DatasetMeta, ColumnMeta
from quarry.plans.spec import Chart
from quarry.sources.adopt import adopt, with_counts


def of(spark, values, kind="double"):
    return adopt(spark.createDataFrame([(v,) for v in values], f"v {kind}"))


@pytest.mark.parametrize(("low", "high", "target", "width"), [(0.003, 0.07, 30, 0.0025), (0.003, 0.07, 12, 0.01), (1, 97, 20, 5), (1, 97, 50, 2), (1000, 98000, 30, 5000), (0, 1, 200, 0.005)])
def test_nice_widths(low, high, target, width):
    bins = nice_bins(low, high, target)
    assert math.isclose(bins.width, width) and bins.start <= low and bins.start + bins.width * bins.count >= high - 1e-9 and nice_bins(high, low, target) == bins


def test_bin_edges():
    assert nice_bins(3, 3) == (2.5, 1, 1) and nice_bins(float("nan"), 1) == (0, 1, 1) and nice_bins(None, None) == (0, 1, 1)
    bins = date_bins(1709819112500, 1709819112500 + 10 * HOUR, 10)
    assert bins.width == HOUR and bins.start % HOUR == 0 and date_bins(5, 5).width == DAY
    assert sum(condense(list(range(100)), 24)) == sum(range(100)) and len(condense(list(range(100)), 24)) == 24


def test_quantitative(spark):
    ds = of(spark, [2, 4, None, 4, 4, 5, None, 5, 7, 9], "int")
    r = stats.stats(ds, filtered(ds), "v").first()
    assert (r["count"], r["nulls"], r["min"], r["max"], r["sum"], r["mean"], r["distinct"], r["p50"], r["p25"], r["p75"]) == (8, 2, 2, 9, 40, 5, 5, 4.5, 4, 5.5)
    assert math.isclose(r["p95"], 8.3) and math.isclose(r["stdev"], 2.138089935299395)
    for base in (1e9, 1.7e12):
        ds = of(spark, [base + k for k in range(5)])
        assert math.isclose(stats.stats(ds, filtered(ds), "v").first()["stdev"], math.sqrt(2.5), rel_tol=1e-9)
    for values, outliers in (([5, 1, 100, 2, 8, 3, -50, 4, 9, 6, 7], 2), ([*range(20), 28, 32], 1)):
        ds = of(spark, values, "int")
        assert stats.stats(ds, filtered(ds), "v").first()["outliers"] == outliers
    ds = of(spark, [None, None])
    r = stats.stats(ds, filtered(ds), "v").first()
    assert (r["count"], r["sum"], r["mean"], r["stdev"]) == (0, 0.0, None, None)
    ds = of(spark, [7.0])
    assert stats.stats(ds, filtered(ds), "v").first()["stdev"] == 0


def test_categorical_and_bool(spark):
    ds = of(spark, ["a", "a", "a", "bb", "bb", "ccc", "", None, "a", "bb", None, "dddd"], "string")
    r = stats.stats(ds, filtered(ds), "v").first()
    assert tuple(r) == (10, 2, 5, 0, 4, 1.7, 1)
    assert [tuple(x) for x in stats.top_values(ds, filtered(ds), "v", 2).collect()] == [("a", 4), ("bb", 3)]
    ds = of(spark, [True, None, False, True], "boolean")
    assert tuple(stats.stats(ds, filtered(ds), "v").first()) == (3, 1, 2, 1)
    assert stats.stats(ds, filtered(ds), "unknown").first()["count"] == 0


def test_profiles(spark):
    data = [(1, "a", True), (2, "b", False), (None, "a", None), (4, None, True), (5, "c", True), (6, "a", False), (None, "b", None), (8, None, True)]
    ds = with_counts(adopt(spark.createDataFrame(data, "n int, s string, b boolean")))
    found = {r["column_id"]: r for r in stats.profiles(ds, filtered(ds), ["s", "b", "zz", "n"]).collect()}
    assert sorted((r["position"], c) for c, r in found.items()) == [(0, "s"), (1, "b"), (2, "n")]
    assert found["n"]["completeness"] == 0.75 and sum(found["n"]["spark"]) == 6 and found["b"]["spark"] == [2, 4] and found["s"]["spark"] == [3, 2, 1]


def test_histogram_has_all_bins(spark):
    ds = of(spark, [0.0, 0.1, 9.9, 10.0, None])
    out = stats.histogram(ds, filtered(ds), "v", 10).orderBy("bin_start").collect()
    assert len(out) == 10 and sum(r["count"] for r in out) == 4 and out[-1]["count"] == 2
    ds = of(spark, ["x"], "string")
    assert stats.histogram(ds, filtered(ds), "v").count() == 0


def test_bars_and_other(spark):
    rows = [k for k, n in zip("ABCDEF", (10, 8, 6, 4, 2, 1), strict=True) for _ in range(n)] + [None] * 3
    ds = with_counts(of(spark, rows, "string"))
    spec = Chart("bar", "v", limit=3)
    out = {r["label"]: r for r in charts.chart(ds, filtered(ds), spec).data.collect()}
    assert list(sorted(out)) == ["A", "B", "C", "Other"] and out["Other"]["y"] == 7 and charts.facts_of(ds, filtered(ds), spec) == {"total_categories": 6, "truncated": True, "sampled": 31}
    pairs = [("a", 100), ("a", 100), ("b", 90), ("b", 90)] + [(c, 10) for c in "cdef" for _ in range(2)]
    ds = adopt(spark.createDataFrame(pairs, "x string, v int"))
    data = charts.chart(ds, filtered(ds), Chart("bar", "x", "v", "avg", limit=2)).data
    assert {r["label"]: r["y"] for r in data.collect()} == {"a": 100, "b": 90, "Other": 10}
    assert charts.chart(ds, filtered(ds), Chart("bar", "zz")).data.count() == 0
    ds = adopt(spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 10.0), ("b", None)], "x string, v double"))
    for fn, expected in (("count", (3, 2)), ("avg", (2, 10)), ("sum", (4, 10)), ("nulls", (1, 1)), ("median", (2, 10))):
        data = {r["label"]: r["y"] for r in charts.chart(ds, filtered(ds), Chart("bar", "x", "v", fn)).data.collect()}
        assert (data["a"], data["b"]) == expected


def test_wide_axis_and_scatter(spark):
    ds = adopt(spark.createDataFrame([(k,) for k in range(1000)], "x int"))
    out = charts.chart(ds, filtered(ds), Chart("line", "x", bins=10)).data.collect()
    assert [r["x"] for r in out] == [100.0 * k for k in range(10)] and {r["y"] for r in out} == {100}
    ds = adopt(spark.createDataFrame([(1, 10), (2, None), (None, 30), (4, 40), (5, 50), (6, None)], "x int, y int"))
    assert sorted(tuple(r) for r in charts.chart(ds, filtered(ds), Chart("scatter", "x", "y")).data.collect()) == [(1, 10), (4, 40), (5, 50)]
    ds = adopt(spark.range(25_000).selectExpr("id AS x", "id AS y"))
    points = sorted(r["x"] for r in charts.chart(ds, filtered(ds), Chart("scatter", "x", "y")).data.collect())
    assert points == [float(k) for k in range(0, 25_000, 2)]


def test_choice_and_click(spark):
    c = lambda i, kind, d: ColumnMeta(i, i, 0, kind, distinct_count=d)
    assert charts.default_chart(DatasetMeta("d", "d", (c("a", "string", 40), c("b", "bool", 2), c("n", "int", 9)))) == Chart("bar", "b")
    assert charts.default_chart(DatasetMeta("d", "d", (c("a", "string", 400), c("n", "int", 9)))) == Chart("histogram", "n")
    ds = of(spark, ["x"], "string")
    assert charts.filter_of_mark(ds, Chart("bar", "v"), "Other") is None and charts.filter_of_mark(ds, Chart("bar", "v"), "x").value == "x"
