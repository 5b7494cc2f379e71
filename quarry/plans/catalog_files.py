"""Registered queries over text files that are written first: reading, kinds of columns, facts of columns, and the store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.engine import Engine, filtered
from quarry.plans.meta import column_ids, dataset_id
from quarry.plans.registry import query, table
from quarry.plans.spec import Filter, Query, View
from quarry.sources import ingest, samples, sinks, sniff
from quarry.sources.files import Folder
from quarry.sources.scratch import scratch_path
from quarry.sources.store import Store

_PART = ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, lines: DataFrame, name: str, header: str = "") -> str:
    """A folder of text files; each begins with the header, if there is one."""
    path = scratch_path(spark, name)
    if header:
        lines = _with_header(lines, header)
    lines.write.text(path)
    return path


def _json_files(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """The same for texts of JSON, in files that are named as such."""
    path = _lines(spark, lines, name)
    folder = Folder(spark, path)
    for file in folder.names(""):
        if file.endswith(".txt"):
            folder.rename(file, file.removesuffix(".txt") + ".json")
    return path


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([header, *values] if first and values else values, pa.string())], names=["value"])
            first = first and not values

    return lines.toDF("value").mapInArrow(run, "value string")


@query("SELECT p_partkey, p_name, p_brand, cast(p_size AS bigint) p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV, read back as text, with kinds inferred anew."""
    ds = table(spark, sf_dir, "part", *_PART)
    path = scratch_path(spark, "csv")
    sinks.csv_lines(ds, filtered(ds)).write.text(path)
    read = ingest.ingest(spark, path, ingest.Options(header=False)).df
    return read.select(*[F.col(f"column_{k}").alias(n) for k, n in enumerate(_PART, 1)])


@query("SELECT p_partkey, p_name, p_brand, cast(p_size AS bigint) p_size, p_retailprice FROM part")
def csv_folder_round_trip(spark, sf_dir):
    """Four files, each with the header."""
    ds = table(spark, sf_dir, "part", *_PART)
    path = _lines(spark, sinks.csv_lines(ds, filtered(ds)).repartition(4), "csv", sinks.header(ds))
    return ingest.ingest(spark, path).df.select(*_PART)


@query("SELECT o_orderkey, o_orderstatus || ', \"' || o_orderpriority || '\"' || chr(10) || 'x' AS note, o_totalprice FROM orders")
def csv_export_round_trip(spark, sf_dir):
    """An export of several parts, of which the first has the header; fields hold commas, quotes and line ends."""
    ds = table(spark, sf_dir, "orders", "o_orderkey", "concat(o_orderstatus, ', \"', o_orderpriority, '\"', chr(10), 'x') AS note", "o_totalprice")
    path = scratch_path(spark, "export")
    sinks.write_csv(ds, filtered(ds).repartition(3), path)
    return ingest.ingest(spark, path).df.select("o_orderkey", "note", "o_totalprice")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, count(*) AS n_rids FROM orders")
def csv_row_ids(spark, sf_dir):
    """Row ids of several files differ."""
    ds = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    path = _lines(spark, sinks.csv_lines(ds, filtered(ds)).repartition(5), "csv", sinks.header(ds))
    return ingest.ingest(spark, path).df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_ids"), F.count_distinct("__rid").alias("n_rids"))


@query("SELECT o_orderkey AS a, o_custkey AS b, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderstatus END AS c, (SELECT count(*) FROM orders WHERE o_orderkey % 3 > 0) AS bad FROM orders")
def csv_ragged(spark, sf_dir):
    """Rows in need of a field, rows with one too many, and blank lines."""
    o = _raw(spark, sf_dir, "orders")
    key, rest = F.col("o_orderkey"), [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")]
    line = F.when(key % 3 == 1, F.concat_ws(",", *rest[:2])).when(key % 3 == 2, F.concat_ws(",", *rest, F.lit("extra"))).otherwise(F.concat_ws(",", *rest))
    lines = o.select(F.explode(F.when(key % 7 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))).alias("value"))
    ds = ingest.ingest(spark, _lines(spark, lines, "ragged", "a,b,c"))
    return ds.df.select("a", "b", "c", F.lit(ds.meta.bad_rows).cast("bigint").alias("bad"))


@query("SELECT n_nationkey::bigint AS n, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def csv_null_tokens(spark, sf_dir):
    """Null tokens of all files, and one of the caller's."""
    n = _raw(spark, sf_dir, "nation")
    token = F.element_at(F.array(*[F.lit(t) for t in ("N/A", "none", "-", "MISSING")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    lines = n.select(F.concat_ws(",", "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(token)))
    return ingest.ingest(spark, _lines(spark, lines, "nulls", "n,name"), ingest.Options(null_tokens=("missing",))).df.select("n", "name")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def csv_max_rows(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    path = _lines(spark, sinks.csv_lines(ds, filtered(ds)), "csv", sinks.header(ds))
    return ingest.ingest(spark, path, ingest.Options(max_rows=100)).df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier")
def csv_semicolons(spark, sf_dir):
    """The delimiter is told from the text."""
    lines = _raw(spark, sf_dir, "supplier").select(F.concat_ws(";", "s_suppkey", "s_name", "s_acctbal"))
    return ingest.ingest(spark, _lines(spark, lines, "semicolons", "k;name;bal")).df.select("k", "name", "bal")


@query("SELECT * FROM (VALUES ('a.csv', 'delimited'), ('a.jsonl', 'ndjson'), ('a.json', 'json'), ('b.json', 'ndjson'), ('c', 'delimited')) t(file, format)")
def format_detection(spark, sf_dir):
    heads = {"a.csv": b"[", "a.jsonl": b"", "a.json": b" [1]", "b.json": b"{}", "c": b"a,b"}
    return spark.createDataFrame([(n, sniff.detect_format(n, h)) for n, h in heads.items()], "file string, format string")


@query("SELECT o_orderkey AS a, o_totalprice > 200000 AS ok FROM orders")
def text_to_bool(spark, sf_dir):
    words = F.when(F.col("o_totalprice") > 200_000, F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("TRUE")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, "n").otherwise("false"))
    lines = _raw(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", words))
    return ingest.ingest(spark, _lines(spark, lines, "bools", "a,ok")).df.select("a", "ok")


@query("SELECT event_id AS k, date_trunc('second', ts)::timestamp AS created_at FROM events")
def text_to_epoch(spark, sf_dir):
    """Whole numbers under a header of a date are seconds since the epoch."""
    lines = _raw(spark, sf_dir, "events").select(F.concat_ws(",", "event_id", F.unix_seconds(F.col("ts").cast("timestamp"))))
    return ingest.ingest(spark, _lines(spark, lines, "epochs", "k,created_at")).df.select("k", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT * FROM (VALUES ('1|2', 'int'), ('1|2.5', 'float'), ('yes|no', 'bool'), ('2024-01-02|2024-01-03', 'date'), ('1|x', 'string'), ('|NA', 'string')) t(samples, kind)")
def kinds_of_samples(spark, sf_dir):
    made = ["1|2", "1|2.5", "yes|no", "2024-01-02|2024-01-03", "1|x", "|NA"]
    return spark.createDataFrame([(m, ingest.infer_kind(spark, m.split("|"))) for m in made], "samples string, kind string")


@query("SELECT event_id, user_id, event_type, value FROM events")
def ndjson_round_trip(spark, sf_dir):
    """A table written as lines of JSON in several files and read back."""
    path = scratch_path(spark, "json")
    _raw(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").repartition(4).write.json(path)
    return ingest.ingest(spark, path).df.select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS props_k FROM events")
def json_flatten(spark, sf_dir):
    """Objects within records become columns of their own."""
    lines = _raw(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")))
    return ingest.ingest(spark, _json_files(spark, lines, "props")).df.select("event_id", "props_k")


@query("SELECT o_orderkey AS id, o_custkey AS a_b, '[' || o_orderkey || ',' || o_custkey || ']' AS a_c, '{\"e\":\"' || o_orderstatus || '\"}' AS a_d, o_totalprice > 200000 AS flag FROM orders")
def json_nested(spark, sf_dir):
    """One level of objects is flattened; arrays and deeper objects are JSON text."""
    a = F.struct(F.col("o_custkey").alias("b"), F.array("o_orderkey", "o_custkey").alias("c"), F.struct(F.col("o_orderstatus").alias("e")).alias("d"))
    path = scratch_path(spark, "nested")
    _raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), (F.col("o_totalprice") > 200_000).alias("flag")).write.json(path)
    return ingest.ingest(spark, path).df.select("id", "a_b", "a_c", "a_d", "flag")


@query("SELECT n_nationkey::bigint AS k, n_name AS name FROM nation")
def json_array(spark, sf_dir):
    """An array over several lines in one file, of a table that is small at every scale."""
    records = F.concat(F.lit('{"k":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"'), "n_name", F.lit('"}'))
    whole = _raw(spark, sf_dir, "nation").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(records), ",\n"), F.lit("\n]")))
    return ingest.ingest(spark, _json_files(spark, whole, "array")).df.select("k", "name")


@query("SELECT n_nationkey::bigint AS k, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS bad FROM nation WHERE n_nationkey % 5 > 0")
def json_bad_records(spark, sf_dir):
    record = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "{bad:").otherwise('{"k":'), F.col("n_nationkey").cast("string"), F.lit("}"))
    ds = ingest.ingest(spark, _json_files(spark, _raw(spark, sf_dir, "nation").select(record), "bad"))
    return ds.df.select("k", F.lit(ds.meta.bad_rows).cast("bigint").alias("bad"))


@query("SELECT * FROM (VALUES (1, 'x,1', true), (2, 'he said \"hi\"', false), (3, NULL, true)) t(a, b, c)")
def buffer_of_text(spark, sf_dir):
    """A small buffer with quotes, and with CR, LF and both as line ends."""
    text = b'\xef\xbb\xbfa,b,c\r\n1,"x,1",yes\r2,"he said ""hi""",no\n3,,yes\n'
    return ingest.ingest_bytes(spark, text, "t.csv").df.select(F.col("a").cast("int").alias("a"), "b", "c")


@query("SELECT 'o_totalprice' AS column_id, count(*) * 8 AS \"bytes\", count(*) * 16 AS naive FROM orders UNION ALL SELECT 'o_orderpriority', 4 * count(*) + cast(2 * sum(length(o_orderpriority)) * count(DISTINCT o_orderpriority) // count(*) AS bigint) + 24 * count(DISTINCT o_orderpriority), count(*) * 40 FROM orders")
def memory_report(spark, sf_dir):
    """Bytes of columns as ingest counts them, and as values kept one by one would take."""
    ds = table(spark, sf_dir, "orders", "o_totalprice", "o_orderpriority")
    path = _lines(spark, sinks.csv_lines(ds, filtered(ds)), "csv", sinks.header(ds))
    return spark.createDataFrame(ingest.estimate_naive(ingest.ingest(spark, path).meta), "column_id string, bytes bigint, naive bigint")


@query("SELECT * FROM (VALUES ('reading'), ('scanning'), ('parsing')) t(phase)")
def ingest_phases(spark, sf_dir):
    seen: list[str] = []
    path = _lines(spark, _raw(spark, sf_dir, "nation").select("n_name"), "phases", "name")
    ingest.ingest(spark, path, progress=lambda phase, ratio: seen.append(phase))
    return spark.createDataFrame([(p,) for p in dict.fromkeys(seen)], "phase string")


@query("SELECT * FROM (VALUES (0, 'first_name'), (1, 'first_name_2'), (2, 'column_3'), (3, 'größe')) t(place, id)")
def ids_of_headers(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(column_ids(["First Name", "First-Name", " ", "Größe"]))), "place int, id string")


@query("SELECT true AS same, true AS differs, 'ds_' AS prefix")
def ids_of_datasets(spark, sf_dir):
    one, two = dataset_id("a.csv", 10, 1), dataset_id("a.csv", 11, 1)
    return spark.createDataFrame([(one == dataset_id("a.csv", 10, 1), one != two, one[:3])], "same boolean, differs boolean, prefix string")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def store_round_trip(spark, sf_dir):
    """A dataset saved in a store, listed, and loaded from it."""
    store = Store(spark, scratch_path(spark, "store"))
    ds = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    store.save(ds)
    return store.load(store.datasets()[0].id).df.select("c_custkey", "c_name", "c_acctbal")


@query("SELECT 1 AS datasets, 1 AS views, true AS available, 1 AS cleared, 0 AS datasets_left, 0 AS views_left")
def store_report(spark, sf_dir):
    store = Store(spark, scratch_path(spark, "store"))
    ds = table(spark, sf_dir, "nation")
    store.save(ds)
    store.save_view(View("v1", ds.meta.id, "all"))
    report = store.report()
    cleared = store.clear()
    left = store.report()
    row = (report["datasets"], report["views"], report["available"] and report["usage"] < report["quota"], cleared, left["datasets"], left["views"])
    return spark.createDataFrame([row], "datasets int, views int, available boolean, cleared int, datasets_left int, views_left int")


@query("SELECT 1 AS views_before, 0 AS views_after, true AS gone")
def store_delete(spark, sf_dir):
    store = Store(spark, scratch_path(spark, "store"))
    ds = table(spark, sf_dir, "nation")
    store.save(ds)
    store.save_view(View("v1", ds.meta.id, "all", Query()))
    before = len(store.views(ds.meta.id))
    store.delete(ds.meta.id)
    return spark.createDataFrame([(before, len(store.views(ds.meta.id)), store.load(ds.meta.id) is None)], "views_before int, views_after int, gone boolean")


@query("SELECT * FROM (VALUES ('ecommerce', 500), ('iot_sensors', 500), ('web_events', 500)) t(preset, n)")
def sample_rows(spark, sf_dir):
    out = None
    for preset in ("ecommerce", "iot_sensors", "web_events"):
        rows = samples.sample(spark, preset, 500).df.agg(F.lit(preset).alias("preset"), F.count(F.lit(1)).cast("int").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT count(*) AS written, count(*) AS matched FROM orders WHERE o_totalprice >= 200000")
def export_rows(spark, sf_dir):
    """The rows that an engine's export says it wrote, and those of its query."""
    engine = Engine(spark)
    engine.open(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"))
    facts = engine.query(Query((Filter("o_totalprice", "gte", 200_000),)))
    written = engine.export_csv(scratch_path(spark, "export"))
    engine.dispose()
    return spark.createDataFrame([(written, facts["matched"])], "written bigint, matched bigint")
