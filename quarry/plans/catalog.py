"""Registered queries over the reference's own operators, on the driver's tables, and their DuckDB SQL.

Queries over typed tables adopt them first; nulls are put in where a table has none, so that null rules are seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import charts, grouping, rows, stats, values
from quarry.plans.engine import filtered
from quarry.plans.registry import at, query, table
from quarry.plans.spec import Agg, Chart, Filter, Group, Search, Sort
from quarry.sources import ingest, sinks

@query("SELECT l_returnflag AS key_l_returnflag, l_linestatus AS key_l_linestatus, count(*) AS group_count, round(cast(sum(l_extendedprice) AS double), 2) AS s, round(avg(l_discount), 6) AS a FROM lineitem WHERE l_quantity >= 25 GROUP BY 1, 2")
def flagship_filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = table(spark, sf_dir, "lineitem")
    spec = Group(("l_returnflag", "l_linestatus"), (Agg("s", "sum", "l_extendedprice"), Agg("a", "avg", "l_discount")))
    out = grouping.group(ds, at(ds, Filter("l_quantity", "gte", 25)), spec)
    return out.select("key_l_returnflag", "key_l_linestatus", "group_count", F.round("agg_s", 2).alias("s"), F.round("agg_a", 6).alias("a"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05")
def filter_quant(spark, sf_dir):
    ds = table(spark, sf_dir, "lineitem")
    return at(ds, Filter("l_quantity", "gte", 25), Filter("l_discount", "lt", 0.05)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def filter_between(spark, sf_dir):
    return at(table(spark, sf_dir, "orders"), Filter("o_totalprice", "between", "200000", 100000)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN timestamp '1996-01-01' AND timestamp '1996-12-31'")
def filter_between_date(spark, sf_dir):
    out = at(table(spark, sf_dir, "orders"), Filter("o_orderdate", "between", "1996-01-01", "1996-12-31"))
    return out.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') p FROM orders) SELECT o_orderkey, p FROM t WHERE lower(p) <> '1-urgent'")
def filter_ne_null(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS p")
    return at(ds, Filter("p", "ne", "1-Urgent")).select("o_orderkey", "p")


@query("WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') p FROM orders) SELECT o_orderkey FROM t WHERE p IS NULL AND o_orderkey % 2 = 1 OR FALSE")
def filter_is_null(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS p", "o_orderkey % 2 = 1 AS odd")
    return at(ds, Filter("p", "isNull"), Filter("odd", "isTrue")).select("o_orderkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') AND starts_with(lower(p_type), 'eco')")
def filter_text_ci(spark, sf_dir):
    return at(table(spark, sf_dir, "part"), Filter("p_name", "contains", "RING"), Filter("p_type", "startsWith", "Eco")).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(p_name), 'e') AND ends_with(lower(p_type), 'd')")
def filter_text_not(spark, sf_dir):
    return at(table(spark, sf_dir, "part"), Filter("p_name", "notContains", "E"), Filter("p_type", "endsWith", "D")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND lower(c_mktsegment) NOT IN ('machinery')")
def filter_in_notin(spark, sf_dir):
    ds = table(spark, sf_dir, "customer")
    return at(ds, Filter("c_mktsegment", "in", values=("Building", "MACHINERY")), Filter("c_mktsegment", "notIn", values=("machinery",))).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')")
def filter_regex(spark, sf_dir):
    return at(table(spark, sf_dir, "orders"), Filter("o_orderpriority", "regex", "^[12]-")).select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, quality FROM labels WHERE toxic = 1")
def filter_bool(spark, sf_dir):
    ds = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic = 1 AS is_toxic")
    return at(ds, Filter("is_toxic", "isTrue"), Filter("is_toxic", "eq", "yes")).select("doc_id", "quality")


@query("SELECT event_id FROM events WHERE contains(lower(event_type), '12') OR contains(lower(props), '12') OR event_id = 12 OR starts_with(cast(event_id AS varchar), '12') OR starts_with(cast(user_id AS varchar), '12') OR value = 12 OR starts_with(cast(cast(floor(abs(value)) AS bigint) AS varchar), '12')")
def search_all(spark, sf_dir):
    return at(table(spark, sf_dir, "events"), search=Search("12")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= timestamp '1996-03-01' AND o_orderdate < timestamp '1996-04-01'")
def search_month(spark, sf_dir):
    return at(table(spark, sf_dir, "orders"), search=Search("1996-03", ("o_orderdate",))).select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY lower(o_orderpriority), o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def sort_window(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    sorts = (Sort("o_orderpriority"), Sort("o_totalprice", True), Sort("o_orderkey"))
    return rows.window(ds, filtered(ds), sorts, 100, 50, ["o_orderkey", "o_orderpriority", "o_totalprice", "unknown"]).drop("__rid")


@query("WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') p FROM orders), n AS (SELECT count(*) c FROM t WHERE p IS NOT NULL) SELECT o_orderkey, p FROM t ORDER BY lower(p) DESC NULLS LAST, p DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET (SELECT c - 20 FROM n)")
def sort_nulls_last(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS p")
    frame = filtered(ds)
    known = frame.filter("p IS NOT NULL").count()
    return rows.window(ds, frame, (Sort("p", True), Sort("o_orderkey")), known - 20, 40).drop("__rid")


_AGGS = (
    Agg("n", "count", "l_quantity"), Agg("s", "sum", "l_extendedprice"), Agg("a", "avg", "l_quantity"), Agg("mn", "min", "l_discount"), Agg("mx", "max", "l_discount"),
    Agg("med", "median", "l_extendedprice"), Agg("d", "distinct", "l_partkey"), Agg("nl", "nulls", "l_quantity"),
)


@query("SELECT l_returnflag, l_linestatus, count(*) group_count, count(l_quantity) n, round(cast(sum(l_extendedprice) AS double), 2) s, round(avg(l_quantity), 6) a, min(l_discount) mn, max(l_discount) mx, median(l_extendedprice) med, least(count(DISTINCT l_partkey), 100000) d, count(*) - count(l_quantity) nl FROM lineitem GROUP BY 1, 2")
def group_all_aggs(spark, sf_dir):
    ds = table(spark, sf_dir, "lineitem")
    out = grouping.group(ds, filtered(ds), Group(("l_returnflag", "l_linestatus"), _AGGS))
    exact = [F.col(f"agg_{k}").alias(k) for k in ("n", "mn", "mx", "med", "d", "nl")]
    return out.select(F.col("key_l_returnflag").alias("l_returnflag"), F.col("key_l_linestatus").alias("l_linestatus"), "group_count", F.round("agg_s", 2).alias("s"), F.round("agg_a", 6).alias("a"), *exact)


@query("WITH t AS (SELECT nullif(l_returnflag, 'A') k, CASE WHEN l_quantity > 10 THEN NULL ELSE l_quantity END v FROM lineitem) SELECT k, count(*) group_count, count(*) - count(v) nl, round(cast(sum(v) AS double), 2) s FROM t GROUP BY 1")
def group_null_key(spark, sf_dir):
    ds = table(spark, sf_dir, "lineitem", "nullif(l_returnflag, 'A') AS k", "CASE WHEN l_quantity <= 10 THEN l_quantity END AS v")
    out = grouping.group(ds, filtered(ds), Group(("k",), (Agg("nl", "nulls", "v"), Agg("s", "sum", "v"))))
    return out.select(F.col("key_k").alias("k"), "group_count", F.col("agg_nl").alias("nl"), F.round("agg_s", 2).alias("s"))


@query("SELECT o_orderstatus, cast(epoch_ms(min(o_orderdate)) AS double) mn, cast(epoch_ms(max(o_orderdate)) AS double) mx, round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0::double ELSE 0.0::double END), 6) share FROM orders GROUP BY 1")
def group_date_bool_measure(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate", "o_totalprice > 250000 AS big")
    out = grouping.group(ds, filtered(ds), Group(("o_orderstatus",), (Agg("mn", "min", "o_orderdate"), Agg("mx", "max", "o_orderdate"), Agg("b", "avg", "big"))))
    return out.select(F.col("key_o_orderstatus").alias("o_orderstatus"), F.col("agg_mn").alias("mn"), F.col("agg_mx").alias("mx"), F.round("agg_b", 6).alias("share"))


@query("SELECT l_shipdate AS k, count(*) AS group_count, round(cast(sum(l_quantity) AS double), 2) AS s FROM lineitem GROUP BY 1 ORDER BY s DESC, k LIMIT 20")
def group_sorted_window(spark, sf_dir):
    ds = table(spark, sf_dir, "lineitem")
    out = grouping.group_window(ds, filtered(ds), Group(("l_shipdate",), (Agg("s", "sum", "l_quantity"),)), (Sort("l_quantity", True), Sort("l_shipdate")), 0, 20)
    return out.select(F.col("key_l_shipdate").cast("timestamp_ntz").alias("k"), "group_count", F.round("agg_s", 2).alias("s"))


@query('SELECT p_brand AS value, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def distinct_values(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    return values.distinct_values(ds, filtered(ds), "p_brand", 10)


@query('SELECT cast(p_size AS varchar) AS value, count(*) AS "count" FROM part GROUP BY 1')
def distinct_numeric_text(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    return values.distinct_values(ds, filtered(ds), "p_size")


@query("SELECT min(o_totalprice) mn, max(o_totalprice) mx FROM orders")
def extent(spark, sf_dir):
    return values.extent(table(spark, sf_dir, "orders"), "o_totalprice").select(F.col("min").alias("mn"), F.col("max").alias("mx"))


@query("WITH q AS (SELECT quantile_cont(value, 0.25) p25, quantile_cont(value, 0.75) p75 FROM events) SELECT count(value) n, count(*) - count(value) nulls, count(DISTINCT value) d, min(value) mn, max(value) mx, round(avg(value), 6) mean, round(median(value), 6) med, round(any_value(p25), 6) p25, round(any_value(p75), 6) p75, round(quantile_cont(value, 0.95), 6) p95, round(stddev_samp(value), 6) sd, round(cast(sum(value) AS double), 2) s, cast(sum(CASE WHEN value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25) THEN 1 ELSE 0 END) AS bigint) outliers FROM events, q")
def stats_numeric(spark, sf_dir):
    ds = table(spark, sf_dir, "events")
    out = stats.quantitative_stats(ds, filtered(ds), "value")
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    return out.select(F.col("count").alias("n"), "nulls", F.col("distinct").alias("d"), F.col("min").alias("mn"), F.col("max").alias("mx"), r("mean", "mean"), r("p50", "med"), r("p25", "p25"), r("p75", "p75"), r("p95", "p95"), r("stdev", "sd"), r("sum", "s", 2), "outliers")


@query('WITH e AS (SELECT min(l_extendedprice) mn, max(l_extendedprice) mx FROM lineitem), r AS (SELECT mn, mx, (mx - mn) / 30 raw, pow(10.0::double, floor(log10((mx - mn) / 30))) mag FROM e), w AS (SELECT mn, mx, CASE WHEN mag >= raw THEN mag WHEN mag * 2 >= raw THEN mag * 2 WHEN mag * 2.5::double >= raw THEN mag * 2.5::double WHEN mag * 5 >= raw THEN mag * 5 ELSE mag * 10 END width FROM r), g AS (SELECT width, floor(mn / width) * width st, greatest(1, least(400, cast(ceil((mx - floor(mn / width) * width) / width) AS bigint))) cnt FROM w), b AS (SELECT unnest(range(0, cnt)) i, st, width, cnt FROM g), h AS (SELECT least(greatest(cast(floor((l_extendedprice - st) / width) AS bigint), 0), cnt - 1) i, count(*) n FROM lineitem, g GROUP BY 1) SELECT st + b.i * width bin_start, st + (b.i + 1) * width bin_end, coalesce(n, 0) "count" FROM b LEFT JOIN h ON b.i = h.i')
def hist_nice(spark, sf_dir):
    ds = table(spark, sf_dir, "lineitem")
    return stats.histogram(ds, filtered(ds), "l_extendedprice", 30)


_UNITS = "(1000), (10000), (60000), (300000), (900000), (3600000), (21600000), (86400000), (604800000), (2592000000), (7862400000), (31536000000)"


@query(f'WITH e AS (SELECT epoch_ms(min(o_orderdate)) mn, epoch_ms(max(o_orderdate)) mx FROM orders), u(unit) AS (VALUES {_UNITS}), g AS (SELECT unit FROM u, e ORDER BY abs((mx - mn) / unit::double - 30), unit LIMIT 1) SELECT cast(floor(epoch_ms(o_orderdate) / unit::double) AS bigint) * unit bin_start_ms, count(*) "count" FROM orders, g GROUP BY 1')
def hist_date(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return stats.histogram(ds, filtered(ds), "o_orderdate", 30).filter("count > 0").select(F.col("bin_start").cast("bigint").alias("bin_start_ms"), "count")


@query("SELECT count(o_orderpriority) n, count(DISTINCT o_orderpriority) d, min(length(o_orderpriority)) mnl, max(length(o_orderpriority)) mxl, round(avg(length(o_orderpriority)), 6) avl, cast(sum(CASE WHEN o_orderpriority = '' THEN 1 ELSE 0 END) AS bigint) empties FROM orders")
def stats_categorical(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    out = stats.categorical_stats(ds, filtered(ds), "o_orderpriority")
    return out.select(F.col("count").alias("n"), F.col("distinct").alias("d"), F.col("min_len").alias("mnl"), F.col("max_len").alias("mxl"), F.round("avg_len", 6).alias("avl"), "empties")


@query("SELECT count(*) AS count, cast(0 AS bigint) AS nulls, count(*) FILTER (toxic = 1) AS trues, count(*) FILTER (toxic <> 1) AS falses FROM labels")
def stats_bool(spark, sf_dir):
    ds = table(spark, sf_dir, "labels", "toxic = 1 AS is_toxic")
    return stats.bool_stats(ds, filtered(ds), "is_toxic")


@query("WITH t AS (SELECT nullif(l_returnflag, 'A') k, CASE WHEN l_quantity > 10 THEN NULL ELSE l_quantity END v FROM lineitem) SELECT 'k' column_id, round(count(k) / count(*)::double, 6) completeness FROM t UNION ALL SELECT 'v', round(count(v) / count(*)::double, 6) FROM t")
def profile_completeness(spark, sf_dir):
    ds = table(spark, sf_dir, "lineitem", "nullif(l_returnflag, 'A') AS k", "CASE WHEN l_quantity <= 10 THEN l_quantity END AS v")
    return stats.profiles(ds, filtered(ds)).select("column_id", F.round("completeness", 6).alias("completeness"))


@query("WITH g AS (SELECT p_brand k, sum(p_retailprice) sm, count(p_retailprice) n, count(*) r FROM part GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY sm / n DESC, k) rk FROM g) SELECT CASE WHEN rk <= 5 THEN k ELSE 'Other' END label, round(cast(sum(sm) / sum(n) AS double), 6) y, cast(sum(r) AS bigint) \"rows\" FROM o GROUP BY 1")
def chart_bar_other_avg(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    out = charts.chart(ds, filtered(ds), Chart("bar", "p_brand", "p_retailprice", "avg", limit=5))
    return out.data.select("label", F.round("y", 6).alias("y"), "rows")


@query("WITH g AS (SELECT p_brand k, median(p_retailprice) v FROM part GROUP BY 1), o AS (SELECT k, row_number() OVER (ORDER BY v DESC, k) rk FROM g) SELECT CASE WHEN rk <= 5 THEN part.p_brand ELSE 'Other' END label, round(median(p_retailprice), 6) y FROM part JOIN o ON part.p_brand = o.k GROUP BY 1")
def chart_bar_other_median(spark, sf_dir):
    ds = table(spark, sf_dir, "part")
    out = charts.chart(ds, filtered(ds), Chart("bar", "p_brand", "p_retailprice", "median", limit=5))
    return out.data.select("label", F.round("y", 6).alias("y"))


@query(f"WITH e AS (SELECT epoch_ms(min(o_orderdate)) mn, epoch_ms(max(o_orderdate)) mx FROM orders), u(unit) AS (VALUES {_UNITS}), g AS (SELECT unit FROM u, e ORDER BY abs((mx - mn) / unit::double - 30), unit LIMIT 1) SELECT cast(floor(epoch_ms(o_orderdate) / unit::double) AS bigint) * unit x, round(avg(o_totalprice), 4) y FROM orders, g GROUP BY 1")
def chart_line_date(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    out = charts.chart(ds, filtered(ds), Chart("line", "o_orderdate", "o_totalprice", "avg", bins=30))
    return out.data.select(F.col("x").cast("bigint").alias("x"), F.round("y", 4).alias("y"))


@query("SELECT l_extendedprice x, cast(l_partkey AS double) y FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 i, count(*) OVER () n FROM lineitem) WHERE i % cast(ceil(n / 20000.0) AS bigint) = 0")
def chart_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows than points. Source order is an order of the table's values here, so that SQL can number rows alike."""
    ds = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return charts.chart(ds, filtered(ds).withColumn("__rid", order), Chart("scatter", "l_extendedprice", "l_partkey")).data


@query("SELECT cast(o_orderkey AS varchar) || ',' || CASE WHEN contains(o_orderpriority, ',') THEN '\"' || o_orderpriority || '\"' ELSE o_orderpriority END || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') line FROM orders")
def csv_lines(spark, sf_dir):
    ds = table(spark, sf_dir, "orders")
    return sinks.csv_lines(ds, filtered(ds), ["o_orderkey", "o_orderpriority", "o_orderdate"])


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::timestamp d FROM orders")
def text_to_date(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"))
    plan = ingest.decide(ingest.evidence(texts, ["order_date"])[0], "order_date")
    return texts.select("o_orderkey", ingest.typed(F.col("order_date"), plan).cast("timestamp_ntz").alias("d"))


@query("SELECT o_orderkey, o_totalprice v FROM orders")
def text_to_number(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice")).alias("price"))
    plan = ingest.decide(ingest.evidence(texts, ["price"])[0], "price")
    return texts.select("o_orderkey", ingest.typed(F.col("price"), plan).alias("v"))
