"""Registered queries over typed tables: filters and search of all kinds, groups, values, statistics, charts and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import format as shown
from quarry.operators import charts, grouping, rows, stats, values
from quarry.plans.engine import Engine, filtered
from quarry.plans.registry import at, query, table
from quarry.plans.spec import OPS, Agg, Chart, Filter, Group, Layout, Query, Search, Sort, View, toggle_sort
from quarry.sources import adopt

_BIG = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_totalprice > 200000 AS big", "nullif(o_orderpriority, '5-LOW') AS p")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_totalprice > 200000)")
def filter_not_null_false(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", *_BIG)
    return at(ds, Filter("p", "notNull"), Filter("big", "isFalse")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def filter_is_empty(spark, sf_dir):
    ds = table(spark, sf_dir, "part", "p_partkey", "CASE WHEN p_size % 2 = 0 THEN '' WHEN p_size % 3 > 0 THEN p_name END AS t")
    return at(ds, Filter("t", "isEmpty")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 100 AND o_custkey <= 400 AND o_custkey <> 250 AND o_orderstatus = 'F'")
def filter_compare(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", *_BIG)
    tests = (Filter("o_custkey", "gt", "100"), Filter("o_custkey", "lte", 400), Filter("o_custkey", "ne", 250.0), Filter("o_orderstatus", "eq", "f"), Filter("o_orderstatus", "eq", "zz", enabled=False))
    return at(ds, *tests).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_custkey = 250")
def filter_bool_equal(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", *_BIG)
    return at(ds, Filter("big", "ne", "no"), Filter("o_custkey", "eq", 250), Filter("nowhere", "eq", 1)).select("o_orderkey")


@query("SELECT count(*) FILTER (contains(p_name, 'ring')) AS sensitive, 0::bigint AS none FROM part")
def filter_case_sensitive(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    hits = at(ds, Filter("p_name", "contains", "ring", case_sensitive=True)).agg(F.count(F.lit(1)).alias("sensitive"))
    return hits.crossJoin(at(ds, Filter("p_name", "contains", "RING", case_sensitive=True)).agg(F.count(F.lit(1)).alias("none")))  # one row each


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def search_bool(spark, sf_dir):
    return at(table(spark, sf_dir, "orders", *_BIG), search=Search("Tru", ("big",))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 OR contains(o_orderpriority, '1997')")
def search_year(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return at(ds, search=Search("1997", ("o_orderdate", "o_orderpriority"))).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE contains(c_mktsegment, 'BUILD')")
def search_case_sensitive(spark, sf_dir):
    return at(table(spark, sf_dir, "customer"), search=Search("BUILD", ("c_mktsegment",), True)).select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 30")
def sort_toggled(spark, sf_dir):
    """A click on a header sorts upwards, a second one downwards; another key is added."""
    sorts = toggle_sort(toggle_sort((), "o_custkey"), "o_custkey")
    sorts = toggle_sort(sorts, "o_orderkey", additive=True)
    ds = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return rows.window(ds, filtered(ds), sorts, 0, 30).drop("__rid")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_custkey LIMIT 25")
def layout_window(spark, sf_dir):
    """A page of the visible columns: one is hidden, one pinned, one moved."""
    ds = table(spark, sf_dir, "customer")
    layout = Layout(tuple(c.id for c in ds.meta.columns)).hide("c_name").hide("c_nationkey").toggle_pin("c_mktsegment").move("c_acctbal", "c_custkey")
    return rows.window(ds, filtered(ds), (Sort("c_custkey"),), 0, 25, layout.visible()).drop("__rid")


@query("SELECT * FROM (VALUES (0, 100, 300), (50, 3000, 2000), (0, -5, 195)) t(first, last, fetched)")
def page_sizes(spark, sf_dir):
    asked = [(0, 100), (50, 3000), (0, -5)]
    return spark.createDataFrame([(a, b, rows.page_bounds(a, b)[1]) for a, b in asked], "first int, last int, fetched int")


@query("SELECT NULL::varchar AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders")
def group_unknown_key(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    out = grouping.group(ds, filtered(ds), Group(("nowhere",), (Agg("s", "sum", "o_totalprice"),)))
    return out.select(F.col("key_nowhere").alias("k"), F.col("group_count").alias("n"), F.round("agg_s", 2).alias("s"))


@query("SELECT c_nationkey::bigint AS k, median(c_acctbal) AS med, count(*) AS n FROM customer GROUP BY 1")
def group_medians(spark, sf_dir):
    ds = table(spark, sf_dir, "customer")
    out = grouping.group(ds, filtered(ds), Group(("c_nationkey",), (Agg("m", "median", "c_acctbal"),)))
    return out.select(F.col("key_c_nationkey").alias("k"), F.col("agg_m").alias("med"), F.col("group_count").alias("n"))


@query("SELECT * FROM (VALUES ('o_totalprice', 'sum'), ('o_orderstatus', 'count')) t(column_id, fn)")
def group_default_measure(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(c, grouping.default_aggregate(ds, c).fn) for c in ("o_totalprice", "o_orderstatus")], "column_id string, fn string")


@query("SELECT * FROM (VALUES ('o_custkey'), ('o_orderdate'), ('o_orderkey'), ('o_orderpriority'), ('o_orderstatus')) t(column_id)")
def group_key_columns(spark, sf_dir):
    """Float columns aren't offered as keys."""
    return spark.createDataFrame([(c,) for c in grouping.key_columns(table(spark, sf_dir, "orders"))], "column_id string")


@query('SELECT o_orderpriority AS value, count(*) AS "count" FROM orders WHERE contains(lower(o_orderpriority), \'i\') GROUP BY 1')
def distinct_everywhere(spark, sf_dir):
    """Values of the whole table with a term, whatever the current filters."""
    engine = Engine(spark)
    engine.open(table(spark, sf_dir, "orders"))
    engine.query(Query((Filter("o_orderstatus", "eq", "F"),)))
    return engine.distinct("o_orderpriority", 200, "I", everywhere=True)


@query('SELECT \'\' AS value, 0::bigint AS "count" WHERE false')
def distinct_unknown(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return values.distinct_values(ds, filtered(ds), "nowhere")


@query('SELECT p AS value, count(*) AS "count" FROM (SELECT nullif(o_orderpriority, \'5-LOW\') p FROM orders) GROUP BY 1')
def distinct_with_null(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", *_BIG)
    return values.distinct_values(ds, filtered(ds), "p")


@query('SELECT p_type AS value, count(*) AS "count" FROM part GROUP BY 1')
def top_values(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    return stats.top_values(ds, filtered(ds), "p_type", 1000)


@query("WITH t AS (SELECT epoch_ms(o_orderdate)::double v FROM orders) SELECT count(v) n, min(v) mn, max(v) mx, round(quantile_cont(v, 0.5), 0) med, round(quantile_cont(v, 0.95), 0) p95 FROM t")
def stats_dates(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    out = stats.stats(ds, filtered(ds), "o_orderdate")
    return out.select(F.col("count").alias("n"), F.col("min").alias("mn"), F.col("max").alias("mx"), F.round("p50", 0).alias("med"), F.round("p95", 0).alias("p95"))


@query("SELECT 0::bigint AS n, 0::bigint AS nulls, 0::bigint AS d")
def stats_unknown(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return stats.stats(ds, filtered(ds), "nowhere").select(F.col("count").alias("n"), "nulls", F.col("distinct").alias("d"))


@query("WITH s AS (SELECT 'o_orderstatus' column_id, string_agg(n, ',' ORDER BY n DESC) spark FROM (SELECT count(*) n FROM orders GROUP BY o_orderstatus)), b AS (SELECT 'big', (count(*) FILTER (NOT o_totalprice > 200000)) || ',' || (count(*) FILTER (o_totalprice > 200000)) FROM orders), k AS (SELECT 'o_totalprice', cast(count(*) AS varchar) FROM orders) SELECT * FROM s UNION ALL SELECT * FROM b UNION ALL SELECT * FROM k")
def profile_sparks(spark, sf_dir):
    """Counts of texts, of false and true, and the whole of a number's bins."""
    ds = table(spark, sf_dir, "orders", *_BIG)
    out = stats.profiles(ds, filtered(ds), ["o_orderstatus", "big", "o_totalprice"])
    counts = F.transform("spark", lambda x: x.cast("bigint"))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("string")
    return out.select("column_id", F.when(F.col("column_id") == "o_totalprice", total).otherwise(F.array_join(counts, ",")).alias("spark"))


@query("SELECT 'Brand#' AS kind, 0 AS n_marks UNION ALL SELECT 'names', 0")
def profile_many_texts(spark, sf_dir):
    """Columns of more than a hundred texts have no counts of them."""
    ds = table(spark, sf_dir, "part", "concat('Brand#', p_partkey % 101) AS b", "concat(p_name, p_partkey) AS n")
    out = stats.profiles(ds, filtered(ds))
    return out.select(F.when(F.col("column_id") == "b", "Brand#").otherwise("names").alias("kind"), F.size("spark").alias("n_marks"))


_NICE = "WITH e AS (SELECT min({v}) mn, max({v}) mx FROM {t}), r AS (SELECT mn, mx, (mx - mn) / {n} raw, pow(10.0::double, floor(log10((mx - mn) / {n}))) mag FROM e), w AS (SELECT mn, mx, CASE WHEN mag >= raw THEN mag WHEN mag * 2 >= raw THEN mag * 2 WHEN mag * 2.5::double >= raw THEN mag * 2.5::double WHEN mag * 5 >= raw THEN mag * 5 ELSE mag * 10 END width FROM r), g AS (SELECT width, floor(mn / width) * width st, greatest(1, least(400, cast(ceil((mx - floor(mn / width) * width) / width) AS bigint))) cnt FROM w), h AS (SELECT least(greatest(cast(floor(({v} - st) / width) AS bigint), 0), cnt - 1) i, count(*) n, any_value(st) st, any_value(width) width FROM {t}, g GROUP BY 1)"


@query(_NICE.format(v="o_totalprice", t="orders", n=20) + ' SELECT st + i * width AS bin_start, n AS "count" FROM h')
def chart_histogram(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return charts.chart(ds, filtered(ds), Chart("histogram", "o_totalprice", bins=20)).data.filter("count > 0").select("bin_start", "count")


@query("WITH g AS (SELECT p_brand k, sum(p_retailprice) v, count(*) n FROM part GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) rk FROM g) SELECT CASE WHEN rk <= 4 THEN k ELSE 'Other' END label, round(cast(sum(v) AS double), 2) y, cast(sum(n) AS bigint) \"rows\" FROM o GROUP BY 1")
def chart_pie(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    out = charts.chart(ds, filtered(ds), Chart("pie", "p_brand", "p_retailprice", "sum", limit=4))
    return out.data.select("label", F.round("y", 2).alias("y"), "rows")


@query(_NICE.format(v="l_quantity", t="lineitem", n=40) + " SELECT st + i * width AS x, n::double AS y FROM h")
def chart_bar_binned(spark, sf_dir):
    """Bars over a number with too many values for one bar each."""
    ds = table(spark, sf_dir, "lineitem")
    return charts.chart(ds, filtered(ds), Chart("bar", "l_quantity", limit=1000)).data.select("x", "y")


@query("SELECT o_orderstatus AS label, 0.0::double AS s, 0.0::double AS d, NULL::double AS a FROM orders GROUP BY 1")
def chart_unmeasured(spark, sf_dir):
    """Booleans and texts aren't measured on a y axis: sums and distinct counts are 0, averages are nothing."""
    ds = table(spark, sf_dir, "orders", *_BIG)
    one = lambda fn, y: charts.chart(ds, filtered(ds), Chart("bar", "o_orderstatus", y, fn)).data.select("label", F.col("y").alias("v"))
    s, d, a = one("sum", "big"), one("distinct", "p").withColumnRenamed("v", "d"), one("avg", "p").withColumnRenamed("v", "a")
    return s.withColumnRenamed("v", "s").join(d, "label").join(a, "label")


@query("SELECT o_orderpriority AS label, count(*)::double AS y, 'rows' AS title FROM orders GROUP BY 1")
def chart_counts(spark, sf_dir):
    """Without a y column, bars count rows."""
    ds = table(spark, sf_dir, "orders")
    out = charts.chart(ds, filtered(ds), Chart("bar", "o_orderpriority", fn="avg"))
    return out.data.select("label", "y", F.lit(out.label).alias("title"))


@query("SELECT 'text' AS axis, count(DISTINCT p_brand) AS k, count(DISTINCT p_brand) > 12 AS truncated, count(p_brand) AS n FROM part UNION ALL SELECT * FROM (" + _NICE.format(v="p_retailprice", t="part", n=40) + " SELECT 'binned', count(*), count(*) > 12, cast(sum(n) AS bigint) FROM h)")
def chart_facts(spark, sf_dir):
    """Marks that a chart has or would have, and rows that reach one."""
    ds = table(spark, sf_dir, "part")
    found = [("text", charts.facts_of(ds, filtered(ds), Chart("bar", "p_brand"))), ("binned", charts.facts_of(ds, filtered(ds), Chart("bar", "p_retailprice")))]
    return spark.createDataFrame([(a, f["total_categories"], f["truncated"], f["sampled"]) for a, f in found], "axis string, k bigint, truncated boolean, n bigint")


@query("SELECT ''::varchar AS label, 0.0::double AS y WHERE false")
def chart_empty(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return charts.chart(ds, filtered(ds), Chart("bar", "nowhere")).data.select("label", "y")


@query("SELECT 'bar' AS kind, 'o_orderstatus' AS x UNION ALL SELECT 'histogram', 's_suppkey'")
def chart_default(spark, sf_dir):
    few = adopt.with_counts(table(spark, sf_dir, "orders"))
    none = adopt.with_counts(table(spark, sf_dir, "supplier", "s_suppkey", "concat(s_name, s_suppkey) AS name", "s_acctbal"))
    return spark.createDataFrame([(c.kind, c.x) for c in (charts.default_chart(few.meta), charts.default_chart(none.meta))], "kind string, x string")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def chart_click(spark, sf_dir):
    """A click on a mark filters by it; one on Other does nothing."""
    ds = table(spark, sf_dir, "orders")
    spec = Chart("bar", "o_orderstatus")
    clicked = [charts.filter_of_mark(ds, spec, "P"), charts.filter_of_mark(ds, spec, charts.OTHER)]
    return at(ds, *[f for f in clicked if f]).select("o_orderkey")


@query("SELECT count(*) AS matched, (SELECT count(*) FROM orders) AS total, count(DISTINCT o_orderstatus) AS group_count FROM orders WHERE o_totalprice >= 200000")
def query_facts(spark, sf_dir):
    engine = Engine(spark)
    engine.open(table(spark, sf_dir, "orders"))
    facts = engine.query(Query((Filter("o_totalprice", "gte", 200_000),), group=Group(("o_orderstatus",))))
    engine.dispose()
    return spark.createDataFrame([(facts["matched"], facts["total"], facts["group_count"])], "matched bigint, total bigint, group_count bigint")


@query("SELECT count(*) AS matched FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000")
def view_applied(spark, sf_dir):
    engine = Engine(spark)
    meta = engine.open(table(spark, sf_dir, "orders"))
    view = View("v", meta.id, "cheap", Query((Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "lt", 100_000))))
    facts = engine.apply_view(view)
    engine.dispose()
    return spark.createDataFrame([(facts["matched"],)], "matched bigint")


@query("SELECT * FROM (VALUES ('bool', 4), ('quantitative', 9), ('string', 12)) t(kind, n)")
def filter_menus(spark, sf_dir):
    return spark.createDataFrame([(k, len(v)) for k, v in OPS.items()], "kind string, n int")


@query("SELECT * FROM (VALUES ('number', '1,234.5'), ('none', '–'), ('size', '1.5 KB'), ('short', '250 ms'), ('long', '2 m 5 s'), ('day', '1970-01-02'), ('time', '1970-01-01 00:00:01')) t(what, text)")
def display_formats(spark, sf_dir):
    made = [
        ("number", shown.number(1234.5)), ("none", shown.number(None)), ("size", shown.size(1536)), ("short", shown.duration(250)), ("long", shown.duration(125_000)),
        ("day", shown.date(86_400_000)), ("time", shown.date(1000)),
    ]
    return spark.createDataFrame(made, "what string, text string")
