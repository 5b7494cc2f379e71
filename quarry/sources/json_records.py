"""JSON arrays, concatenated values and lines as flat records of text values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import kept


class Number(str):
    """A number as its text stood."""


_PARSE = {"parse_int": Number, "parse_float": Number, "parse_constant": Number}


def _dump(value) -> str:
    """Compact JSON; numbers as they stood."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def scalar_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    return _dump(value)


def flatten(value) -> list[tuple[str, str | None]]:
    """One level of objects as a.b; deeper values and arrays as JSON; a bare value is the column value. First key wins."""
    if not isinstance(value, dict):
        return [("value", scalar_text(value))]
    out: dict[str, str | None] = {}
    for key, inner in value.items():
        if isinstance(inner, dict):
            for k, v in inner.items():
                out.setdefault(f"{key}.{k}", scalar_text(v))
        else:
            out.setdefault(key, scalar_text(inner))
    return list(out.items())


def split_values(text: str, array: bool, left_open: list | None = None) -> Iterator[str]:
    """Top-level values, parted by spaces and stray commas; of an array, up to its end. A value left open ends the text, and
    is noted in left_open, if given."""
    at, n = 0, len(text)
    if array:
        at = text.find("[") + 1
    while at < n:
        while at < n and (text[at].isspace() or text[at] in ",﻿"):
            at += 1
        if at >= n or (array and text[at] == "]"):
            return
        begin, depth, quoted = at, 0, False
        while at < n:
            c = text[at]
            if quoted:
                if c == "\\":
                    at += 1
                elif c == '"':
                    quoted = False
                    if depth == 0:
                        at += 1
                        break
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                if depth == 0:
                    break
                depth -= 1
                if depth == 0:
                    at += 1
                    break
            elif depth == 0 and (c.isspace() or c == ","):
                break
            at += 1
        if depth > 0 or quoted:
            if left_open is not None:
                left_open.append(begin)
            return
        if at == begin:
            at += 1
            continue
        yield text[begin:at]


def parsed(text: str) -> list[tuple[str, str | None]] | None:
    """The flat record, or None if it isn't JSON."""
    try:
        return flatten(json.loads(text, **_PARSE))
    except (ValueError, RecursionError):
        return None


SCHEMA = "__rid long, keys array<string>, vals array<string>"


def _columns(record: list[tuple[str, str | None]] | None) -> tuple[list | None, list | None]:
    return (None, None) if record is None else ([k for k, _ in record], [v for _, v in record])


#: What a row of a scan of lines is: a record, a line that opens or closes an array, and one whose last value goes on.
RECORD, OPENS, CLOSES, GOES_ON = range(4)
_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("keys", pa.list_(pa.string())), ("vals", pa.list_(pa.string()))])
_LINES_SCHEMA = "file string, block long, kind int, seq long, keys array<string>, vals array<string>"


def _scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """The records of files line by line, which many tasks share; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, block) != at:
                    at, seq = (file, block), 0
                line = value.decode("utf-8", "replace").strip("\ufeff \t\r\n")
                if line in ("[", "]"):
                    rows.append((file, block, OPENS if line == "[" else CLOSES, seq, None, None))
                    seq += 1
                    continue
                left_open: list[int] = []
                for text in split_values(line, False, left_open):
                    rows.append((file, block, RECORD, seq, *_columns(parsed(text))))
                    seq += 1
                if left_open:
                    rows.append((file, block, GOES_ON, seq, None, None))
                    seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCANNED, strict=True)], schema=_SCANNED)

    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    return kept(lines.mapInArrow(run, _LINES_SCHEMA), "json-lines")


def _read_whole(spark: SparkSession, path: str, array: bool) -> DataFrame:
    """(file, seq, keys, vals) of each record, each file split by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                names = ["file", "seq", "keys", "vals"]
                out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], names=names)
                for at, text in enumerate(split_values(content.decode("utf-8", "replace"), array)):
                    rows.append((file, at, *_columns(parsed(text))))
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, seq long, keys array<string>, vals array<string>")


def read(spark: SparkSession, path: str, array: bool) -> DataFrame:
    """(__rid, keys, vals) of each record, in the order of the files' names and of their places; keys are null for a bad one.

    Where each line holds whole values (and an array's brackets have lines of their own), lines are read by many tasks;
    that gives the records that reading a file whole gives. Other files are split by one task each, up to 2 GB.
    """
    scanned = _scan_lines(spark, path)
    blocks = scanned.groupBy("file", "block").agg(
        F.count_if(F.col("kind") == GOES_ON).alias("goes_on"), F.count_if(F.col("kind") == OPENS).alias("opens"), F.count_if(F.col("kind") == CLOSES).alias("closes"),
        F.min(F.struct("seq", "kind")).alias("first"), F.max(F.struct("seq", "kind")).alias("last"),
    ).collect()  # one row a split
    blocks.sort(key=lambda r: (r["file"], r["block"]))
    if _by_lines(blocks, array):
        places = spark.createDataFrame([(r["file"], r["block"], k) for k, r in enumerate(blocks)] or [("", 0, 0)], "file string, block long, ordinal long")
        found = scanned.filter(F.col("kind") == RECORD).join(F.broadcast(places), ["file", "block"])
    else:
        whole = kept(_read_whole(spark, path, array), "json-records")
        files = sorted(r["file"] for r in whole.select("file").distinct().collect())  # one row a file
        places = spark.createDataFrame([(f, k) for k, f in enumerate(files)] or [("", 0)], "file string, ordinal long")
        found = whole.join(F.broadcast(places), "file")
    return found.select((F.shiftleft("ordinal", 32) + F.col("seq")).alias("__rid"), "keys", "vals")


def _by_lines(blocks: list, array: bool) -> bool:
    """Whether lines give the records that whole files do."""
    if any(r["goes_on"] for r in blocks):
        return False
    if not array:
        return not any(r["opens"] or r["closes"] for r in blocks)
    files: dict[str, list] = {}
    for r in blocks:
        files.setdefault(r["file"], []).append(r)
    ends = lambda rows: rows[0]["first"]["kind"] == OPENS and rows[-1]["last"]["kind"] == CLOSES
    return all(ends(rows) and sum(r["opens"] for r in rows) == sum(r["closes"] for r in rows) == 1 for rows in files.values())


def key_order(records: DataFrame) -> list[str]:
    """All keys, as first seen."""
    keys = records.select("__rid", F.posexplode("keys").alias("p", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("__rid", "p")).alias("first"))
    return [r["key"] for r in first.orderBy("first").collect()]  # as many as columns
