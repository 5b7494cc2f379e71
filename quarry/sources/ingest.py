"""Text files as typed datasets: every value takes part in the choice of a column's kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import textparse as tp
from quarry.plans.meta import ColumnMeta, Dataset, DatasetMeta, column_ids, dataset_id, now_ms
from quarry.sources import delimited, json_records
from quarry.sources.sniff import SAMPLE_BYTES, detect_format, sniff_delimiter

SAFE_INTEGER = 2**53 - 1
#: Rows from which numeric columns have no count of distinct texts, and texts beyond which no column has one.
NUMERIC_ROWS, DISTINCT_CAP = 10_000, 65_536
#: Lines of a file that its format is told by.
SAMPLE_LINES = 2000
#: Ranges in which whole numbers under a date header are seconds or milliseconds since the epoch.
EPOCH_SECONDS, EPOCH_MILLIS = (1e8, 1e11), (1e11, 1e14)


@dataclass(frozen=True)
class Options:
    delimiter: str | None = None
    header: bool = True
    null_tokens: tuple[str, ...] = ()
    max_rows: int = 0


@dataclass(frozen=True)
class Plan:
    """The kind of a column, and how its texts are read."""

    kind: str
    date_format: str | None = None  # iso, mdy, dmy, epoch-s or epoch-ms


def evidence(texts: DataFrame, columns: list[str]) -> list[dict]:
    """What decides each column's kind: counts of its non-null texts by form, and the extent of its numbers. One job for
    numbers and booleans of all columns, and one for dates of those that may hold some."""
    facts = []
    for k, c in enumerate(columns):
        s = F.col(f"`{c}`")
        facts.append(
            F.struct(
                s.alias("s"), tp.number(s).alias("v"), tp.is_whole(s).alias("whole"), tp.has_currency(s).alias("currency"), tp.has_percent(s).alias("percent"), tp.has_groups(s).alias("grouped"), tp.is_bool(s).alias("bool"),
            ).alias(f"x{k}")
        )
    exprs = []
    for k in range(len(columns)):
        x = F.col(f"x{k}")
        number, n = x["v"].isNotNull(), f"{k}"
        exprs += [
            F.count(x["s"]).alias("present" + n), F.count_if(number).alias("numbers" + n), F.count_if(x["whole"]).alias("wholes" + n), F.count_if(number & x["currency"]).alias("currency" + n),
            F.count_if(number & x["percent"]).alias("percent" + n), F.count_if(number & x["grouped"]).alias("grouped" + n), F.count_if(x["whole"] & ~x["grouped"] & (F.abs(x["v"]) >= 1000)).alias("large_plain" + n),
            F.count_if(x["whole"] & (F.abs(x["v"]) > SAFE_INTEGER)).alias("unsafe" + n), F.count_if(x["bool"]).alias("bools" + n), F.count_if(x["bool"] & ~x["s"].isin("0", "1")).alias("bool_words" + n),
            F.min(x["v"]).alias("low" + n), F.max(x["v"]).alias("high" + n), F.sum(F.length(x["s"])).alias("chars" + n), F.sum(F.octet_length(x["s"])).alias("bytes" + n), F.approx_count_distinct(x["s"]).alias("about" + n),
        ]
    row = texts.select(*facts).agg(F.count(F.lit(1)).alias("rows"), *exprs).first()
    found = [{n: row[f"{n}{k}"] for n in _COUNTED} | dict.fromkeys(_DATES, 0) | {"rows": row["rows"]} for k in range(len(columns))]
    open_ = [k for k, e in enumerate(found) if e["present"] and e["numbers"] < e["present"] and e["bools"] < e["present"]]
    if open_:
        held = [F.struct(tp.date_shape(F.col(f"`{columns[k]}`")).alias("shape"), tp.date(F.col(f"`{columns[k]}`")).isNotNull().alias("date"), F.col(f"`{columns[k]}`").alias("s")).alias(f"x{k}") for k in open_]
        dates = []
        for k in open_:
            x = F.col(f"x{k}")
            slash = x["shape"] == "slash"
            dates += [F.count_if(x["date"]).alias(f"dates{k}"), F.count_if(x["date"] & (x["shape"] == "iso")).alias(f"iso{k}"), F.count_if(slash & (tp.first_short(x["s"]) > 12)).alias(f"first_day{k}"), F.count_if(slash & (tp.second_short(x["s"]) > 12)).alias(f"second_day{k}")]
        row = texts.select(*held).agg(*dates).first()
        for k in open_:
            found[k] |= {n: row[f"{n}{k}"] for n in _DATES}
    return found


_COUNTED = ("present", "numbers", "wholes", "currency", "percent", "grouped", "large_plain", "unsafe", "bools", "bool_words", "low", "high", "chars", "bytes", "about")
_DATES = ("dates", "iso", "first_day", "second_day")


def decide(e: dict, header: str) -> Plan:
    """The kind that all values of a column allow, in order of preference."""
    n = e["present"]
    if n == 0:
        return Plan("string")
    uniform = e["currency"] in (0, n) and e["percent"] in (0, n)
    whole = e["wholes"] == n and uniform and not (e["grouped"] and e["large_plain"])
    bare = whole and not (e["currency"] or e["percent"])
    if bare and tp.date_header(header):
        for label, (low, high) in (("epoch-s", EPOCH_SECONDS), ("epoch-ms", EPOCH_MILLIS)):
            if low <= e["low"] and e["high"] < high:
                return Plan("date", label)
    if e["bools"] == n and (e["bool_words"] or tp.flag_header(header)):
        return Plan("bool")
    if whole:
        return Plan("float" if e["unsafe"] else "int")
    if e["numbers"] == n and uniform and not (e["grouped"] and e["large_plain"] and e["wholes"] == n):
        return Plan("float")
    if e["dates"] == n:
        if e["first_day"] and e["second_day"]:
            return Plan("string")
        if e["iso"]:
            return Plan("date", "iso")
        return Plan("date", "dmy" if e["first_day"] else "mdy")
    return Plan("string")


def infer_kind(spark: SparkSession, samples: list[str], header: str = "") -> str:
    """The kind that a column of these texts would have."""
    texts = spark.createDataFrame([(s,) for s in samples], "s string").select(F.when(~tp.is_null_token(F.col("s")), F.col("s")).alias("s"))
    return decide(evidence(texts, ["s"])[0], header).kind


def typed(s: Column, plan: Plan) -> Column:
    if plan.kind == "int":
        return tp.number(s).cast("bigint")
    if plan.kind == "float":
        return tp.number(s)
    if plan.kind == "bool":
        return tp.boolean(s)
    if plan.kind == "date":
        if plan.date_format in ("epoch-s", "epoch-ms"):
            return F.timestamp_millis((tp.number(s) * (1000 if plan.date_format == "epoch-s" else 1)).cast("bigint"))
        return tp.date(s, "dmy" if plan.date_format == "dmy" else "mdy")
    return s


def byte_size(kind: str, rows: int, distinct: int, chars: int, octets: int) -> int:
    """Bytes of a column in memory: numbers 8 a row, booleans 1, repeated texts a code a row and a dictionary, else their bytes."""
    if kind in ("int", "float", "date"):
        return 8 * rows
    if kind == "bool":
        return rows
    if 0 <= distinct <= DISTINCT_CAP and 2 * distinct <= rows:
        return 4 * rows + (2 * chars * distinct // max(rows, 1)) + 24 * distinct
    return octets + 4 * (rows + 1) + -(-rows // 8)


def _finish(texts: DataFrame, names: list[str], ids: list[str], name: str, bad: int, size: int, delimiter: str | None, progress) -> Dataset:
    """Kinds and typed columns of a frame of __rid and nullable texts."""
    progress("scanning", 0.3)
    found = evidence(texts, ids) if ids else []
    plans = [decide(e, n) for e, n in zip(found, names, strict=True)]
    rows = found[0]["rows"] if found else texts.count()
    # texts are counted one by one where the answer isn't plain from the estimate
    unsure = [k for k, (e, p) in enumerate(zip(found, plans, strict=True)) if not (p.kind in ("int", "float", "date") and e["present"] >= NUMERIC_ROWS) and e["about"] <= 2 * DISTINCT_CAP]
    counted = texts.agg(*[F.count_distinct(F.col(f"`{ids[k]}`")).alias(f"d{k}") for k in unsure]).first() if unsure else {}
    columns = []
    for k, (e, p) in enumerate(zip(found, plans, strict=True)):
        distinct = counted[f"d{k}"] if k in unsure else -1
        distinct = -1 if distinct > DISTINCT_CAP and p.kind in ("int", "float", "date") else distinct
        size_k = byte_size(p.kind, rows, distinct, e["chars"] or 0, e["bytes"] or 0)
        columns.append(ColumnMeta(ids[k], names[k], k, p.kind, rows - e["present"], distinct, size_k, p.date_format))
    progress("parsing", 0.7)
    df = texts.select("__rid", *[typed(F.col(f"`{i}`"), p).alias(i) for i, p in zip(ids, plans, strict=True)])
    created = now_ms()
    meta = DatasetMeta(dataset_id(name, rows, created), name, tuple(columns), rows, sum(c.byte_size for c in columns), size, created, bad, delimiter)
    progress("parsing", 1.0)
    return Dataset(df, meta, has_rid=True)


def _null_tokens(s: Column, options: Options) -> Column:
    return F.when(~tp.is_null_token(s, options.null_tokens), s)


def ingest(spark: SparkSession, path: str, options: Options = Options(), progress=lambda phase, ratio: None) -> Dataset:
    """A CSV, TSV, text, JSON or NDJSON file (or folder of files of one kind) as a dataset, in source order.

    Files of a folder follow each other by name; the header is the first file's first record, and a later file's first
    record if it is the same. Short rows are filled with nulls and long ones cut, and both counted as bad; blank lines are
    skipped, or are null rows where there is one column; bad JSON records are skipped and counted.
    """
    progress("reading", 0.0)
    facts = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("size"), F.min("path").alias("first")).first()
    first = facts["first"] or path
    sample = _head(spark, first) if facts["size"] else b""
    name = first.rsplit("/", 1)[-1]
    size = facts["size"] or 0
    kind = detect_format(name, sample)
    if kind != "delimited":
        return _ingest_json(spark, path, name, kind == "json", size, options, progress)
    text = sample.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "ignore")
    delimiter = (options.delimiter or sniff_delimiter(text, name))[:1]
    return _ingest_fields(delimited.read(spark, path, delimiter), text, delimiter, name, size, options, progress)


def _head(spark: SparkSession, path: str) -> bytes:
    """A file's first bytes, whole lines but for a very long one."""
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("_metadata.file_block_start") == 0)
    out = b""
    for row in lines.select(F.substring(F.col("value").cast("binary"), 1, SAMPLE_BYTES).alias("v"), (F.col("_metadata.file_size")).alias("size")).limit(SAMPLE_LINES).collect():
        out += bytes(row["v"]) + b"\n"
        if len(out) >= SAMPLE_BYTES:
            break
        if len(out) > row["size"]:
            out = out[:-1]  # the last line has no end
    return out[:SAMPLE_BYTES]


def _ingest_fields(rows: DataFrame, sample: str, delimiter: str, name: str, size: int, options: Options, progress) -> Dataset:
    first = next(iter(delimited.tokenize(sample, delimiter)), (None, False))
    if first[0] is None:
        return _finish(rows.select("__rid"), [], [], name, 0, size, delimiter, progress)
    fields = [*first[0], *([""] if first[1] and options.header else [])]
    names = fields if options.header else [f"column_{k}" for k in range(1, len(fields) + 1)]
    ids = column_ids(names)
    n = len(ids)
    if options.header:
        # the first file's first record is the header; later files may repeat it
        head = rows.filter("first").orderBy("__rid").select("__rid", "fields").first()
        if head is not None:
            repeats = F.col("fields") == F.array(*[F.lit(x) for x in head["fields"]]).cast("array<string>")
            rows = rows.filter(~(F.col("first") & ((F.col("__rid") == head["__rid"]) | repeats)))
    blank = (F.size("fields") == 1) & (F.col("fields")[0] == "")
    if n > 1:
        rows = rows.filter(~blank)
    if options.max_rows > 0:
        rows = rows.orderBy("__rid").limit(options.max_rows)
    bad = rows.filter((F.size("fields") != n) & ~(F.lit(n == 1) & blank)).count()
    texts = rows.select("__rid", *[_null_tokens(F.get("fields", F.lit(k)), options).alias(i) for k, i in enumerate(ids)])
    return _finish(texts, names, ids, name, bad, size, delimiter, progress)


def _ingest_json(spark: SparkSession, path: str, name: str, array: bool, size: int, options: Options, progress) -> Dataset:
    records = json_records.read(spark, path, array)
    if options.max_rows > 0:
        records = records.orderBy("__rid").limit(options.max_rows)
    bad = records.filter(F.col("keys").isNull()).count()
    good = records.filter(F.col("keys").isNotNull())
    names = json_records.key_order(good)
    ids = column_ids(names)
    held = good.select("__rid", F.map_from_arrays("keys", "vals").alias("m"))
    texts = held.select("__rid", *[_null_tokens(F.try_element_at("m", F.lit(k)), options).alias(i) for k, i in zip(names, ids, strict=True)])
    return _finish(texts, names, ids, name, bad, size, None, progress)


def ingest_bytes(spark: SparkSession, content: bytes, name: str, options: Options = Options()) -> Dataset:
    """A buffer as a dataset. Small buffers only: the bytes are a value of the plan."""
    kind = detect_format(name, content[:SAMPLE_BYTES])
    quiet = lambda phase, ratio: None
    if kind != "delimited":
        array = kind == "json"
        records = [(k, *json_records._columns(json_records.parsed(t))) for k, t in enumerate(json_records.split_values(content.decode("utf-8", "replace"), array))]
        frame = spark.createDataFrame(records, json_records.SCHEMA)
        bad = sum(1 for r in records if r[1] is None)
        good = frame.filter(F.col("keys").isNotNull())
        names = json_records.key_order(good)
        ids = column_ids(names)
        held = good.select("__rid", F.map_from_arrays("keys", "vals").alias("m"))
        texts = held.select("__rid", *[_null_tokens(F.try_element_at("m", F.lit(k)), options).alias(i) for k, i in zip(names, ids, strict=True)])
        return _finish(texts, names, ids, name, bad, len(content), None, quiet)
    text = content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    delimiter = (options.delimiter or sniff_delimiter(text, name))[:1]
    data = [(k, k == 0, fields) for k, (fields, _) in enumerate(delimited.tokenize(text, delimiter))]
    rows = spark.createDataFrame(data, "__rid long, first boolean, fields array<string>")
    return _ingest_fields(rows, text[:SAMPLE_BYTES], delimiter, name, len(content), options, quiet)


def estimate_naive(meta: DatasetMeta) -> list[tuple[str, int, int]]:
    """(column, bytes, naive bytes) of each column: 40 a row for text and 16 for anything else, if kept one by one."""
    return [(c.id, c.byte_size, meta.row_count * (40 if c.kind == "string" else 16)) for c in meta.columns]
