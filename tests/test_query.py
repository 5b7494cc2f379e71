import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import grouping, predicates, rows, values
from quarry.plans.engine import Engine, filtered
from quarry.plans.meta import Dataset
from quarry.plans.spec import Agg, Filter, Group, Layout, Query, Search, Sort, toggle_sort, view_from, View, to_json
from quarry.sources.adopt import adopt, with_counts


@pytest.fixture(scope="module")
def ds(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    data = [
        (0, 5, 1.5, day(2), True, "apple", "id-001"), (1, 3, -2.5, day(1), False, "Banana", "ID-002"), (2, None, 0.0, None, None, None, None),
        (3, 1, None, day(4), True, "cherry", "id-003"), (4, 9, 10.25, day(3), False, "apple", "id-004"), (5, 3, 1.5, day(1), True, "", ""),
    ]
    df = spark.createDataFrame(data, "__rid long, n int, f double, d timestamp, b boolean, s string, u string").coalesce(1)
    made = adopt(df.drop("__rid"), "six")
    return Dataset(made.df.withColumn("__rid", F.when(F.col("u") == "id-001", 0).when(F.col("u") == "ID-002", 1).when(F.col("u").isNull(), 2).when(F.col("u") == "id-003", 3).when(F.col("u") == "id-004", 4).otherwise(5).cast("long")), made.meta, True, made.raw)


def rids(ds, *filters, search=Search()):
    return sorted(r["__rid"] for r in filtered(ds, Query(filters, search)).collect())


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (Filter("n", "ne", 3), [0, 3, 4]), (Filter("n", "between", 5, 3), [0, 1, 5]), (Filter("n", "between", None, 3), [1, 3, 5]), (Filter("n", "between"), []),
        (Filter("n", "eq", "x"), []), (Filter("n", "isNull"), [2]), (Filter("s", "notIn", values=("apple",)), [1, 3, 5]), (Filter("s", "in", values=("BANANA",)), [1]),
        (Filter("s", "in"), []), (Filter("s", "notIn"), [0, 1, 3, 4, 5]), (Filter("s", "eq", "APPLE"), [0, 4]), (Filter("s", "eq", "APPLE", case_sensitive=True), []),
        (Filter("s", "notContains", "an"), [0, 3, 4, 5]), (Filter("s", "contains", ""), [0, 1, 3, 4, 5]), (Filter("s", "isEmpty"), [5]), (Filter("s", "regex", "^[AB]"), [0, 1, 4]),
        (Filter("s", "regex", "(["), []), (Filter("b", "isFalse"), [1, 4]), (Filter("b", "ne", "yes"), [1, 4]), (Filter("b", "eq", "maybe"), []),
        (Filter("d", "gte", "2024-01-03"), [3, 4]), (Filter("d", "eq", dt.date(2024, 1, 1)), [1, 5]), (Filter("f", "gt", 1), [0, 4, 5]), (Filter("f", "notNull"), [0, 1, 2, 4, 5]),
        (Filter("none", "eq", 1), [0, 1, 2, 3, 4, 5]), (Filter("s", "gt", 1), [0, 1, 2, 3, 4, 5]), (Filter("n", "eq", 9, enabled=False), [0, 1, 2, 3, 4, 5]),
    ],
)
def test_filters(ds, f, expected):
    assert rids(ds, f) == expected


@pytest.mark.parametrize(
    ("term", "columns", "expected"),
    [("an", None, [1]), ("tr", None, [0, 3, 5]), ("2024-01", ("d",), [0, 1, 3, 4, 5]), ("2024-1-03", ("d",), [4]), ("10", None, [4]), ("009", ("n",), [4]), ("zzz", ("n",), []), ("", None, [0, 1, 2, 3, 4, 5]), ("1.5", ("f",), [0, 5])],
)
def test_search(ds, term, columns, expected):
    assert rids(ds, search=Search(term, columns)) == expected


def test_float_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double").write.parquet(str(tmp_path / "t"))
    made = adopt(spark.read.parquet(str(tmp_path / "t")))
    out = filtered(made, Query((Filter("x", "gte", 2),)))
    assert [r["x"] for r in out.collect()] == [3.0]
    assert "GreaterThanOrEqual(x,2.0)" in out._jdf.queryExecution().executedPlan().toString()


def test_order_and_pages(ds):
    frame = filtered(ds)
    order = lambda *s: [r["__rid"] for r in rows.window(ds, frame, s).collect()]
    assert order(Sort("n")) == [3, 1, 5, 0, 4, 2] and order(Sort("n", True)) == [4, 0, 1, 5, 3, 2]
    assert order(Sort("s")) == [5, 0, 4, 1, 3, 2] and order(Sort("unknown")) == [0, 1, 2, 3, 4, 5]
    page = rows.window(ds, frame, (), 4.9, 10, ["s", "nope"])
    assert page.columns == ["__rid", "s"] and [r["__rid"] for r in page.collect()] == [4, 5]
    assert rows.window(ds, frame, (), 99, 5).count() == 0 and rows.page_bounds(0, 5000) == (0, 2000)


def test_groups(spark):
    made = adopt(spark.createDataFrame([("a", 1), ("b", 10), ("a", 2), ("b", 20), ("a", None), ("c", 5), ("c", 5), (None, 7)], "cat string, v int"))
    aggs = tuple(Agg(f, f, "v") for f in ("count", "sum", "avg", "min", "max", "median", "distinct", "nulls")) + (Agg("t", "sum", "cat"), Agg("u", "count", "zz"))
    out = {r["key_cat"]: r for r in grouping.group(made, filtered(made), Group(("cat",), aggs)).collect()}
    a = out["a"]
    assert (a["group_count"], a["agg_sum"], a["agg_avg"], a["agg_min"], a["agg_max"], a["agg_nulls"], a["agg_count"]) == (3, 3.0, 1.5, 1.0, 2.0, 1, 2)
    assert out["b"]["agg_median"] == 15.0 and out["c"]["agg_distinct"] == 1 and out[None]["group_count"] == 1 and a["agg_t"] is None and a["agg_u"] == 3
    ordered = grouping.group_window(made, filtered(made), Group(("cat",), aggs), (Sort("v", True),)).collect()
    assert [r["key_cat"] for r in ordered][0] == "a"  # by the first aggregate on v, its count, then by rows
    empty = filtered(made).filter("false")
    assert grouping.group(made, empty, Group(("cat",))).count() == 0
    assert grouping.group(made, filtered(made), Group(("gone",))).collect()[0]["key_gone"] is None
    with pytest.raises(ValueError):
        grouping.group_window(made, filtered(made), Group())


def test_values_and_extent(ds):
    assert [tuple(r) for r in values.distinct_values(ds, filtered(ds), "s").collect()] == [("apple", 2), ("", 1), ("Banana", 1), ("cherry", 1), (None, 1)]
    assert [r["value"] for r in values.distinct_values(ds, filtered(ds), "f", search="1").collect()] == ["1.5", "10.25"]
    assert values.distinct_values(ds, filtered(ds), "d", 1).first()["value"] == "2024-01-01T00:00:00.000Z"
    assert tuple(values.extent(ds, "n").first()) == (1.0, 9.0) and tuple(values.extent(ds, "s").first()) == (None, None)


def test_counts(ds):
    meta = with_counts(ds).meta
    assert (meta.row_count, meta.column("s").null_count, meta.column("s").distinct_count, meta.column("b").distinct_count) == (6, 1, 4, 2)


def test_layouts_and_sorts():
    s = toggle_sort((), "a")
    s = toggle_sort(s, "b", True)
    assert toggle_sort(s, "a", True) == (Sort("a", True), Sort("b")) and toggle_sort(toggle_sort(s, "a", True), "a", True) == (Sort("b"),)
    layout = Layout(("a", "b", "c")).toggle_pin("c").hide("a").move("b", None)
    assert layout.visible() == ["c", "b"] and layout.show_all().visible() == ["c", "a", "b"]


def test_operands():
    assert predicates.to_number("1970-01-02") == 86_400_000 and predicates.to_number(" 7 ") == 7 and predicates.to_number("") is None and predicates.to_number("x") is None


def test_engine_and_views(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        engine.rows()
    meta = engine.load_sample("web_events", 500)
    assert len(meta.columns) == 14
    spec = Query((Filter("event_type", "eq", "CLICK"),), sorts=(Sort("duration_ms", True),), group=Group(("country",), (Agg("d", "avg", "duration_ms"),)))
    facts = engine.query(spec)
    assert 0 < facts["matched"] < facts["total"] == 500 and facts["group_count"] == engine.groups().count()
    top = [r["duration_ms"] for r in engine.window(0, 5).collect()]
    assert top == sorted(top, reverse=True)
    assert engine.save() > 0 and engine.store.datasets()[0].id == meta.id
    view = View("v1", meta.id, "mine", spec, order=("event_id",))
    engine.store.save_view(view)
    assert engine.store.views(meta.id) == [view] and view_from(to_json(view)) == view
    again = Engine(spark, str(tmp_path / "store"))
    assert again.load_stored(meta.id) and again.apply_view(view)["matched"] == facts["matched"]
    engine.store.delete(meta.id)
    assert engine.store.load(meta.id) is None and engine.store.views(meta.id) == [] and engine.store.report()["datasets"] == 0


def test_failed_save_keeps_views(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store"))
    meta = engine.load_sample("ecommerce", 10)
    engine.store.save_view(View("v", meta.id, "kept"))
    monkeypatch.setattr("quarry.sources.files.Folder.write", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        engine.save()
    assert engine.store.load(meta.id) is None and not (tmp_path / "store/data" / meta.id).exists() and len(engine.store.views(meta.id)) == 1
