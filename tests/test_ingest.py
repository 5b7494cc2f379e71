import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import textparse as tp
from quarry.functions.kinds import number_text
from quarry.plans.engine import Engine, filtered
from quarry.plans.meta import column_ids
from quarry.sources import delimited, ingest, json_records, samples, sinks
from quarry.sources.delimited import tokenize
from quarry.sources.sniff import detect_format, sniff_delimiter


def of(spark, text, name="t.csv", **options):
    return ingest.ingest_bytes(spark, text if isinstance(text, bytes) else text.encode(), name, ingest.Options(**options))


def kinds(ds):
    return [c.kind for c in ds.meta.columns]


def data(ds):
    return [tuple(r) for r in ds.df.orderBy("__rid").drop("__rid").collect()]


def test_tokenizer():
    text = 'a,b\r\n"x,1","he said ""hi"""\r"multi\nline","q"tail\nlast,'
    assert [f for f, _ in tokenize(text, ",")] == [["a", "b"], ["x,1", 'he said "hi"'], ["multi\nline", "q"], ["last"]]
    assert [f for f, _ in tokenize('"open\nend', ",")] == [["open\nend"]] and list(tokenize("", ",")) == []


def test_numbers_and_nulls(spark):
    good = {"1": 1, "-5": -5, "+3.5": 3.5, "$1,234.50": 1234.5, "-$5": -5, "$-5": -5, "€ 7": 7, ".5": 0.5, "5.": 5, "1e3": 1000, "12%": 12, "5 %": 5, " 42 ": 42, "1,234,567": 1234567}
    bad = ["0x10", "Infinity", "1,23", "1e", "--1", "1d", "", "abc", "1 2", "$"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "s string").select("s", tp.number(F.col("s")).alias("v"))
    found = {r["s"]: r["v"] for r in df.collect()}
    assert all(found[k] == v for k, v in good.items()) and all(found[k] is None for k in bad)
    nulls = spark.createDataFrame([(t,) for t in ["", "  ", "NULL", "n/a", "None", "-", "none ", "x", "missing"]], "s string").select(tp.is_null_token(F.col("s"), ["MISSING"])).collect()
    assert [r[0] for r in nulls] == [True] * 6 + [False, False, True]


def test_dates(spark):
    ms = lambda t, order="mdy": spark.createDataFrame([(t,)], "s string").select(F.unix_millis(tp.date(F.col("s"), order))).first()[0]
    assert ms("1970-01-02") == 86_400_000 and ms("1970/1/2 00:00:01.5Z") == 86_401_500 and ms("1970-01-01T02:00:00+02:00") == 0 and ms("01/02/1970") == 86_400_000
    assert ms("01/02/1970", "dmy") == 31 * 86_400_000 and ms("13/02/1970") == ms("02/13/1970") and ms("1970-01-01T00:00:60Z") == 60_000
    assert [ms(t) for t in ("2020", "20200101", "2021-02-30", "2020-01/15", "1970-01-01T24:00", "1970-01-01T00:00+15:00", "99-1-1")] == [None] * 7


def test_kinds_of_columns(spark):
    ds = of(spark, "i,f,b,d,s,p,c,is_ok\n1,1.5,yes,2024-01-02,x,5%,$1,1\n2,2,no,2024-01-03T10:00:00Z,y,7%,$2.5,0\n")
    assert kinds(ds) == ["int", "float", "bool", "date", "string", "int", "float", "bool"] and ds.meta.bad_rows == 0
    assert kinds(of(spark, "a\n1\n2\nx\n")) == ["string"] and kinds(of(spark, "a\n9007199254740993\n1\n")) == ["float"]
    assert kinds(of(spark, "created_at,count\n1700000000,1700000000\n1700000001,1700000001\n")) == ["date", "int"]
    assert [c.date_format for c in of(spark, "a,b,c\n13/02/2020,02/13/2020,01/02/2020\n").meta.columns] == ["dmy", "mdy", "mdy"] and kinds(of(spark, "a\n13/02/2020\n02/13/2020\n")) == ["string"]
    ds = of(spark, "a,b\n,x\nNA,MISSING\n3,y\n", null_tokens=("missing",))
    assert [c.null_count for c in ds.meta.columns] == [2, 1] and data(ds)[2] == (3, "y")
    ds = of(spark, "a,b\n,\n,\n")
    assert kinds(ds) == ["string", "string"] and ds.meta.columns[0].distinct_count == 0
    assert ingest.infer_kind(spark, ["1", "", "2"]) == "int"


def test_ragged_blank_and_options(spark):
    ds = of(spark, "a,b,c\n1,2,3\n4,5\n6,7,8,9\n\n")
    assert ds.meta.bad_rows == 2 and data(ds) == [(1, 2, 3), (4, 5, None), (6, 7, 8)]
    assert data(of(spark, "a\n1\n\n3\n")) == [(1,), (None,), (3,)]
    ds = of(spark, "1;2;3\n4;5;6\n7;8;9\n", header=False, max_rows=2)
    assert [c.id for c in ds.meta.columns] == ["column_1", "column_2", "column_3"] and len(data(ds)) == 2 and ds.meta.delimiter == ";"
    assert data(of(spark, b"\xef\xbb\xbfa,b\r\n1,2\n3,4\r5,6\r\n")) == [(1, 2), (3, 4), (5, 6)]
    assert data(of(spark, "")) == [] and data(of(spark, "a,b\n")) == []


def test_headers_and_sniffing():
    assert column_ids(["First Name", "First-Name", "", "Ünïcödé"]) == ["first_name", "first_name_2", "column_3", "ünïcödé"]
    assert sniff_delimiter("a|b\n1|2\n") == "|" and sniff_delimiter("a\tb,c\n1\t2,3\n", "x.tsv") == "\t" and sniff_delimiter("abc\n") == ","
    assert detect_format("x.json", b" [1]") == "json" and detect_format("x.json", b"{}") == "ndjson" and detect_format("x.json", b"a,b") == "delimited" and detect_format("x.jsonl", b"") == "ndjson"


def test_json(spark):
    ds = of(spark, '[{"a":1,"b":{"c":"x","d":[1,2]}},{"a":"2","e":true},, {"a":3.50}]', "t.json")
    assert [c.name for c in ds.meta.columns] == ["a", "b.c", "b.d", "e"] and [c.id for c in ds.meta.columns] == ["a", "b_c", "b_d", "e"]
    assert data(ds)[0] == (1.0, "x", "[1,2]", None) and kinds(ds)[0] == "float"
    ds = of(spark, '{"a":1}\n{bad}\n{"a":2} {"a":3}\n7', "t.ndjson")
    assert ds.meta.bad_rows == 1 and [c.name for c in ds.meta.columns] == ["a", "value"] and len(data(ds)) == 4
    assert data(of(spark, "[]", "t.json")) == []


def test_files_and_round_trip(spark, tmp_path):
    made = samples.sample(spark, "ecommerce", 300)
    assert len(made.meta.columns) == 15
    (tmp_path / "out.csv").write_bytes(sinks.csv_bytes(made, filtered(made)))
    engine = Engine(spark)
    meta = engine.load_file(str(tmp_path / "out.csv"))
    assert (meta.row_count, meta.bad_rows, [c.name for c in meta.columns]) == (300, 0, [c.name for c in made.meta.columns])
    assert [c.kind for c in meta.columns] == [c.kind for c in made.meta.columns]
    left = [tuple(r) for r in engine.ds.df.drop("__rid").orderBy("order_id").collect()]
    assert left == [tuple(r) for r in made.df.select(*[c.id for c in made.meta.columns]).orderBy("order_id").collect()]
    engine.query()
    assert engine.export_csv(str(tmp_path / "export"), ["order_id", "zz"], 5) == 5
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "export").glob("part-*")))
    assert text.startswith(b"order_id\r\n") and text.endswith(b"\r\n")


def test_csv_fields(spark):
    ds = of(spark, 'text\nplain\n"has,comma"\n"has""quote"\n"has\nnewline"\n')
    assert sinks.csv_bytes(ds, ds.df.orderBy("__rid")) == b'text\r\nplain\r\n"has,comma"\r\n"has""quote"\r\n"has\nnewline"\r\n'


def test_number_text(spark):
    cases = {1.0: "1", 1e7: "10000000", 1e21: "1e+21", 1.5e-7: "1.5e-7", 0.001: "0.001", 0.00012: "0.00012", 123456789.25: "123456789.25", -2.5: "-2.5", 1e20: "100000000000000000000"}
    df = spark.createDataFrame([(v,) for v in cases], "v double").select("v", number_text(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases


@pytest.mark.parametrize("preset", ["ecommerce", "iot_sensors", "web_events", "unknown"])
def test_samples_repeat(spark, preset):
    a, b = (samples.sample(spark, preset, 50) for _ in range(2))
    assert a.df.collect() == b.df.collect() and a.df.count() == 50 and samples.sample(spark, preset, 0).df.count() == 1


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a few dozen bytes."""
    held = {"spark.sql.files.maxPartitionBytes": "250b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quoted_text(seed, rows):
    draw = random.Random(seed)
    field = lambda: draw.choice(["a", "", "12", '5" pipe', '"x,y"', '"he ""said"" so"', '"two\nlines"', '"a\r\nb\n\nc"', '"' + "long\n" * draw.randint(1, 60) + '"', '"q"tail'])
    ends = ["\n"] * 5 + ["\r\n"]
    return "".join(",".join(field() for _ in range(3)) + draw.choice(ends) for _ in range(rows))


@pytest.mark.parametrize("seed,tail", [(1, ""), (2, "1,2,"), (3, '1,"open\nto the end')])
def test_splits_of_quoted_files(spark, tmp_path, small_splits, seed, tail):
    texts = {"a.csv": quoted_text(seed, 20) + tail, "b.csv": "\ufeffh,i\n" + quoted_text(seed + 10, 10), "c.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = delimited.read(spark, str(tmp_path), ",").orderBy("__rid").collect()
    expected = [(k == 0, fields) for text in texts.values() for k, (fields, _) in enumerate(delimited.tokenize(text.removeprefix("\ufeff"), ","))]
    assert [(r["first"], r["fields"]) for r in rows] == expected and len({r["__rid"] for r in rows}) == len(rows)


def test_folders_and_headers(spark, tmp_path):
    for name, text in {"1.csv": "a,b\n1,x\n2,y\n", "2.csv": "a,b\n3,z\n", "3.csv": "4,w\n5,v"}.items():
        (tmp_path / name).write_text(text)
    ds = ingest.ingest(spark, str(tmp_path))
    assert data(ds) == [(1, "x"), (2, "y"), (3, "z"), (4, "w"), (5, "v")] and ds.meta.bad_rows == 0
    assert data(ingest.ingest(spark, str(tmp_path), ingest.Options(max_rows=4)))[3] == (4, "w")


def test_export_of_several_parts_is_one_table(spark, tmp_path):
    made = samples.sample(spark, "web_events", 400)
    sinks.write_csv(made, filtered(made).repartition(4), str(tmp_path / "out"))
    ds = ingest.ingest(spark, str(tmp_path / "out"))
    assert ds.meta.row_count == 400 and ds.df.select("__rid").distinct().count() == 400
    ids = [c.id for c in made.meta.columns]
    assert sorted(map(str, ds.df.select(ids).collect())) == sorted(map(str, made.df.select(ids).collect()))


@pytest.mark.parametrize("text,array", [('{"a":1}\n{"a":2} {"a":3}\n\n7\n{bad}\n{"a":"x"}', False), ('{"a":\n1}\n{"a":2}\n{"a":3', False), ('[\n{"a":1},\n{"a":2}\n]\n', True), ('[{"a":1},\n{"a":[1,2]}]', True), ("[\n[\n]\n]", True)])
def test_lines_of_json_equal_whole_files(spark, tmp_path, small_splits, text, array):
    (tmp_path / "t.json").write_text(text * (1 if array else 20) if not text.endswith("3") else text)
    expected = [json_records.parsed(t) for t in json_records.split_values((tmp_path / "t.json").read_text(), array)]
    rows = json_records.read(spark, str(tmp_path / "t.json"), array).orderBy("__rid").collect()
    assert [None if r["keys"] is None else list(zip(r["keys"], r["vals"], strict=True)) for r in rows] == expected
