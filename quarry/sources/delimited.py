"""Delimited text as rows of fields.

Files are split where Spark splits them. Whether a split begins inside a quoted field depends on all text before it, so a
later split with quotes is tokenised under both suppositions, and a table of one row for each split tells which of the two
holds; records that lie across splits are put together from their pieces. One rule holds at every size.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import kept

#: Bits of __rid that count a split's records; the others number the splits.
PLACE_BITS = 32


@functools.cache
def _stop(delimiter: str) -> re.Pattern:
    """What ends a field without quotes."""
    return re.compile(f"[{re.escape(delimiter)}\r\n]")


def tokenize(text: str, delimiter: str) -> Iterator[tuple[list[str], bool]]:
    """Records as (fields, whether the text ended right behind a delimiter).

    Line ends may be CR, LF or both in one text. Quotes count at a field's beginning only; two make one; what stands between
    a closing quote and the delimiter is dropped; an open quote runs to the end.
    """
    at, n = 0, len(text)
    stop = _stop(delimiter)

    def reach(at: int) -> int:
        found = stop.search(text, at)
        return n if found is None else found.start()

    while at < n:
        fields: list[str] = []
        while True:
            if at < n and text[at] == '"':
                parts, at = [], at + 1
                while True:
                    close = text.find('"', at)
                    if close < 0:
                        parts.append(text[at:])
                        at = n
                        break
                    parts.append(text[at:close])
                    at = close + 1
                    if at < n and text[at] == '"':
                        parts.append('"')
                        at += 1
                        continue
                    break
                fields.append("".join(parts))
                at = reach(at)
            else:
                begin, at = at, reach(at)
                fields.append(text[begin:at])
            if at < n and text[at] == delimiter:
                at += 1
                if at >= n:
                    yield fields, True  # the last field is missing, not empty
                    return
                continue
            break
        if at < n:
            at += 2 if text[at] == "\r" and at + 1 < n and text[at + 1] == "\n" else 1
        yield fields, False


def ends_open(line: str, open_: bool, delimiter: str, stop: re.Pattern) -> bool:
    """Whether a line ends inside a quoted field, by whether it begins in one; stop finds what ends a field."""
    at, n = 0, len(line)
    while True:
        if open_:
            while True:
                close = line.find('"', at)
                if close < 0:
                    return True
                at = close + 1
                if at < n and line[at] == '"':
                    at += 1
                    continue
                break
            open_ = False
        elif at < n and line[at] == '"':
            at, open_ = at + 1, True
            continue
        found = stop.search(line, at)
        if found is None:
            return False
        at = found.end()


# what a row of a scan is: a record, the end of one that began in an earlier split, the beginning of one that goes on in a
# later split, and the facts of a split
RECORD, HEAD, TAIL, FACTS = range(4)

_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("way", pa.int32()), ("kind", pa.int32()), ("seq", pa.int64()), ("fields", pa.list_(pa.string())), ("piece", pa.string()), ("open", pa.bool_()), ("bytes", pa.int64()), ("size", pa.int64())])
_SCHEMA = "file string, block long, way int, kind int, seq long, fields array<string>, piece string, open boolean, bytes long, size long"


class _Reader:
    """The records of one split, from a state: way 0 begins with a record, way 1 inside a quoted field."""

    def __init__(self, file: str, block: int, way: int, delimiter: str):
        self.key, self.delimiter, self.stop = (file, block, way), delimiter, _stop(delimiter)
        self.open, self.in_head = way == 1, way == 1
        self.pending: list[str] = []
        self.last, self.head_ended = "", False
        self.seq, self.bytes = 0, 0

    def row(self, kind: int, fields=None, piece=None, open_=None, size=None) -> tuple:
        return (*self.key, kind, self.seq, fields, piece, open_, self.bytes if kind == FACTS else None, size)

    def feed(self, line: str, octets: int) -> Iterator[tuple]:
        self.bytes += octets + 1
        if not self.open and '"' not in line:
            plain = line.removesuffix("\r")
            if "\r" not in plain:  # nearly all lines
                self.last = line
                yield self.row(RECORD, plain.split(self.delimiter))
                self.seq += 1
                return
        self.open = ends_open(line, self.open, self.delimiter, self.stop) if '"' in line else self.open
        self.pending.append(line)
        if self.open:
            return
        text = "\n".join(self.pending)
        self.pending.clear()
        if self.in_head:
            self.in_head, self.head_ended = False, True
            yield self.row(HEAD, piece=text)
            return
        self.last = text
        for fields, _ in tokenize(text + "\n", self.delimiter):
            yield self.row(RECORD, fields)
            self.seq += 1

    def end(self, size: int) -> Iterator[tuple]:
        """What is left; the facts say whether the split ends inside a field, and else whether right behind a delimiter."""
        behind = False
        if self.pending:
            yield self.row(HEAD if self.in_head else TAIL, piece="\n".join(self.pending))
        else:
            for _, behind in tokenize(self.last, self.delimiter):
                pass
        yield self.row(FACTS, fields=["behind"] if behind else [], piece="head ended" if self.head_ended else None, open_=self.open, size=size)


def scan(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """All records and pieces of the files, under each supposition that a split allows; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, readers, rows, size = None, [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCANNED, strict=True)], schema=_SCANNED)

        def ended() -> None:
            for reader in readers:
                rows.extend(reader.end(size))

        for batch in batches:
            for file, block, whole, value in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (file, block) != at:
                    ended()
                    at, size = (file, block), whole
                    readers = [_Reader(file, block, way, delimiter) for way in ((0, 1) if block else (0,))]
                line = value.removeprefix(b"\xef\xbb\xbf") if not block and not readers[0].bytes else value
                for reader in readers:
                    rows.extend(reader.feed(line.decode("utf-8", "replace"), len(value)))
            if len(rows) >= 5_000:
                yield out()
                rows = []
        ended()
        if rows:
            yield out()

    meta = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.file_size"), F.col("value").cast("binary")]
    return kept(spark.read.option("lineSep", "\n").text(path).select(*meta).mapInArrow(run, _SCHEMA), "records")


class _Split(NamedTuple):
    file: str
    block: int
    way: int
    ordinal: int
    run: int  # the split whose open record its head goes on with, or -1
    trim: int  # the record that ends with the file right behind a delimiter, or -1
    bare: int  # the kind of the piece that ends with a file whose last line has no end, or -1


def _chosen(facts: list) -> list[_Split]:
    """Which supposition holds of each split, in order of files and places; facts has one row for each split and way."""
    by_key = {(r["file"], r["block"], r["way"]): r for r in facts}
    total: dict[str, int] = {}
    for r in facts:
        total[r["file"]] = total.get(r["file"], 0) + (r["bytes"] if r["way"] == 0 else 0)
    out: list[_Split] = []
    places = sorted({(r["file"], r["block"]) for r in facts})
    open_, run, file = False, -1, None
    for ordinal, (name, block) in enumerate(places):
        if name != file:
            file, open_, run = name, False, -1
        row = by_key[name, block, int(open_)]
        last = ordinal + 1 == len(places) or places[ordinal + 1][0] != name
        # each line counts one byte for its end, which the last one may lack; a mark of three bytes at the beginning isn't counted
        unended = total[name] - row["size"] in (1, -2)
        trim = row["seq"] - 1 if last and unended and not row["open"] and row["fields"] else -1
        bare = -1
        if last and unended and row["open"]:
            bare = HEAD if open_ and not row["piece"] else TAIL
        elif last and unended and open_ and row["seq"] == 0:
            bare = HEAD
        out.append(_Split(name, block, int(open_), ordinal, run, trim, bare))
        if row["open"]:
            # a record that was open before and never ended in this split goes on
            run = run if open_ and not row["piece"] else ordinal
        else:
            run = -1
        open_ = row["open"]
    return out


def read(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(__rid, first, fields) of all records, in the order of the files' names and of their places; first marks those that
    begin a file."""
    scanned = scan(spark, path, delimiter)
    facts = scanned.filter(F.col("kind") == FACTS).select("file", "block", "way", "seq", "open", "bytes", "size", "fields", "piece").collect()  # two rows a split at most
    splits = _chosen(facts)
    places = spark.createDataFrame(splits or [_Split("", 0, 0, 0, -1, -1, -1)], "file string, block long, way int, ordinal long, run long, trim long, bare int")
    found = scanned.join(F.broadcast(places), ["file", "block", "way"])
    rid = F.shiftleft("ordinal", PLACE_BITS) + F.col("seq")
    begins = (F.col("block") == 0) & (F.col("seq") == 0)
    whole = F.when(F.col("seq") == F.col("trim"), F.slice("fields", F.lit(1), F.size("fields") - 1)).otherwise(F.col("fields"))
    rows = found.filter(F.col("kind") == RECORD).select(rid.alias("__rid"), begins.alias("first"), whole.alias("fields"))
    if not any(s.run >= 0 for s in splits) and not any(r["open"] for r in facts):
        return rows
    pieces = found.filter(F.col("kind").isin(HEAD, TAIL))
    run = F.when(F.col("kind") == TAIL, F.col("ordinal")).otherwise(F.col("run"))
    part = F.struct("ordinal", (F.col("kind") == TAIL).alias("tail"), F.when(F.col("kind") == TAIL, F.col("seq")).alias("seq"), F.when(F.col("kind") == TAIL, begins).otherwise(False).alias("first"), "piece", (F.col("kind") == F.col("bare")).alias("bare"))
    joined = pieces.select(run.alias("run"), part.alias("part")).groupBy("run").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def run_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = "\n".join(p["piece"] for p in parts) + ("" if parts[-1]["bare"] else "\n")
                for k, (fields, _) in enumerate(tokenize(text, delimiter)):
                    rows.append(((run << PLACE_BITS) + parts[0]["seq"] + k, parts[0]["first"] and k == 0, fields))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["__rid", "first", "fields"])

    return rows.union(joined.mapInArrow(run_records, "__rid long, first boolean, fields array<string>"))
