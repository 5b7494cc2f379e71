"""Removal of repeated strings of 100 bytes across a corpus, by suffix arrays over blocks that content puts together.

Each 100-byte string is represented by the least hash among its 24-byte pieces, its anchor: equal strings have equal
anchors at equal distances. Neighbouring strings with one anchor form a segment. Segments that are equal, anchor and
all, are settled by their place alone: all but the first go. First segments with a common anchor but different
surroundings meet in a task, where a suffix array over their words, counted from the anchor, finds the strings that
they share; bytes are compared before anything is removed. An anchor with a crowd of different surroundings is split by
what stands around it: strings that begin at nearly the same distance before the anchor share a longer core, and those
of one core meet; a core with a crowd is split by exact distance, where equal strings are told by their hash.

What leaves a task is a few bytes for each segment that is the first of its kind there, so copies are settled where
they lie; texts are moved only to fetch the segments in question and to apply the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import by_part, dealt, lean, materialize, parts_for, short_batches, small_enough, text_or_empty
from quarry.llm.suffix_array import suffix_array

LENGTH, PIECE = 100, 24
#: Bytes of texts that a task takes together, and bytes of segments of a suffix array's block (whole anchor groups).
BATCH_BYTES, BLOCK_BYTES = 2 << 20, 1 << 20
#: Bytes of segments' facts that a task holds at once, bytes of them for each byte of text, and segments from which an anchor
#: or a core is a crowd.
PART_BYTES, FACT_SHARE, CROWD = 12 << 20, 0.95, 2048
#: Distances from the anchor that share a core.
NEAR_DISTANCES = 10
WORD = 8
#: Words that any string of LENGTH bytes holds whole, wherever it begins.
WHOLE_WORDS = (LENGTH - WORD + 1) // WORD

U64 = np.uint64
_BASE_ANCHOR, _BASE_SEGMENT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class Hasher:
    """Polynomial hashes, modulo 2**64, of any stretches of a buffer."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = len(data) + len(data) // 8 + 1
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return np.concatenate([[U64(0)], np.cumsum(self.up[: len(data)] * (data.astype(U64) + U64(1)), dtype=U64)])

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[begin]) * self.down[begin])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def _least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Segmenter:
    """Segments of a batch of texts."""

    def __init__(self):
        self.anchor, self.segment = Hasher(_BASE_ANCHOR), Hasher(_BASE_SEGMENT)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """doc (index), begin, length, offset of the anchor, anchor hash, segment hash of each segment, in order."""
        lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        none = np.zeros(0, np.int64)
        if len(data) < LENGTH:
            return none, none, none, none, none.view(U64), none.view(U64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        sums = self.anchor.sums(data)
        at = np.arange(len(data) - PIECE + 1)
        pieces = self.anchor.of(sums, at, at + PIECE)
        # the least upper half wins, the leftmost of equal ones
        best = _least_of_each((pieces & U64(0xFFFFFFFF00000000)) | at.astype(U64), LENGTH - PIECE + 1)
        place = (best & U64(0xFFFFFFFF)).astype(np.int64)
        doc_of = np.repeat(np.arange(len(texts)), lengths)[: len(place)]
        inside = np.arange(len(place)) + LENGTH <= ends[doc_of]
        starts = np.flatnonzero(inside)
        if not len(starts):
            return none, none, none, none, none.view(U64), none.view(U64)
        p, d = place[starts], doc_of[starts]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
        first = starts[new]
        last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1] + LENGTH
        p, d = p[new], d[new]
        shape = _mix((((p - first) << 32) | (last - first)).astype(U64))
        whole = self.segment.of(self.segment.sums(data), first, last)
        return d, first - begins[d], last - first, p - first, pieces[p], _mix(whole + shape)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well where numbers are alike."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(blob: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind), at + n * size


_FIELDS = (("anchor", "<u8"), ("segment", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("begin", "<i8"), ("length", "<u2"), ("offset", "<u2"))


class _Rows(NamedTuple):
    """The rows of a table by their place: (doc, row, doc_id, text), a null id as the least; and the bytes of all texts."""

    frame: DataFrame
    size: int


def _numbered(docs: DataFrame) -> _Rows:
    """Numbers rows by file and place in it, which no other division of the files into tasks can change. A frame that is no
    scan of files is written first."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return _numbered(materialize(docs.select("doc_id", "text"), "documents"))
    size = F.sum(F.octet_length(text_or_empty()))
    files = placed.groupBy("file").agg(F.coalesce(size, F.lit(0)).alias("size"))
    ordinal = F.row_number().over(Window.orderBy("file")).cast("long")  # one row a file
    files = materialize(files.select(F.col("file").alias("of_file"), ordinal.alias("ordinal"), "size"), "files")
    few = F.broadcast(files) if small_enough(files, row_bytes=300) else files
    least = F.lit(-(1 << 63)).cast("long")
    row = F.shiftleft("ordinal", 36) + F.col("place")
    rows = placed.join(few, F.col("file") == F.col("of_file")).select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc"), row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return _Rows(rows, files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])


def _batches(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[list], list[bytes]]]:
    """Values of the first columns, and texts (the last), in lots of BATCH_BYTES or a little more."""
    held, texts, size = [[] for _ in range(columns)], [], 0
    for batch in batches:
        values = [batch.column(k).to_pylist() for k in range(columns)]
        for k, text in enumerate(batch.column(columns).cast(pa.binary()).to_pylist()):
            for h, v in zip(held, values, strict=True):
                h.append(v[k])
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                yield held, texts
                held, texts, size = [[] for _ in range(columns)], [], 0
    if texts:
        yield held, texts


def _segments(rows: DataFrame, parts: int) -> DataFrame:
    """(part, kind, blob): segments by anchor, the first of each kind in its batch (kind 0); and what follows them (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter()
        for (docs, numbers), texts in _batches(batches, 2):
            d, begin, length, offset, anchor, segment = segmenter(texts)
            doc, row = np.array(docs, np.int64), np.array(numbers, np.int64)
            # rows by id, then by place in the table; begins are in order already
            rank = np.empty(len(doc), np.int64)
            rank[np.lexsort((row, doc))] = np.arange(len(doc))
            order = np.lexsort((begin, rank[d], segment, anchor))
            same = np.concatenate([[False], (anchor[order][1:] == anchor[order][:-1]) & (segment[order][1:] == segment[order][:-1])]) if len(order) else np.zeros(0, bool)
            later = np.sort(order[same])
            yield from _removals(row[d[later]], begin[later], begin[later] + length[later], parts)
            kept = np.sort(order[~same])
            part = ((anchor[kept] >> U64(8)) % U64(parts)).astype(np.int32)
            by_part = np.argsort(part, kind="stable")
            kept, part = kept[by_part], part[by_part]
            found = {"anchor": anchor[kept], "segment": segment[kept], "doc": doc[d[kept]], "row": row[d[kept]], "begin": begin[kept], "length": length[kept].astype(np.uint16), "offset": offset[kept].astype(np.uint16)}
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
            blobs = [b"".join(_planes(np.ascontiguousarray(found[f][a:b])) for f, _ in _FIELDS) for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array([0] * len(cuts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    return dealt(rows.select("doc", "row", "text").mapInArrow(lean(run), "part int, kind int, blob binary"), parts)


def _removals(row: np.ndarray, begin: np.ndarray, end: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches to remove as blobs, for rows and begins in order; ones that touch are joined."""
    row, begin, end = _joined(row, begin, end)
    if len(row):
        part = int(row[0] % parts)
        blob = _planes(row) + _planes(begin) + _planes(end)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])


def _joined(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in order of row and begin, of which those that overlap or touch become one."""
    if not len(row):
        return row, begin, end
    # ends so far, within a row
    width = int(end.max()) + 1
    base = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])) * width
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], base[1:] + begin[1:] > reach[:-1]])
    cuts = np.flatnonzero(new)
    return row[cuts], begin[cuts], reach[np.append(cuts[1:], len(row)) - 1] - base[cuts]


def _settled(segments: DataFrame) -> DataFrame:
    """(row, doc, gone, begin, end, anchor, offset): stretches to remove, and first segments that share an anchor."""
    names = ["row", "doc", "gone", "begin", "end", "anchor", "offset"]

    def out(row, doc, gone, begin, end, anchor, offset):
        for at in range(0, len(row), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (row, doc, gone, begin, end, anchor, offset)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(batches):
            yield from settle(rows)

    def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {f: [] for f, _ in _FIELDS}
        size = sum(np.dtype(k).itemsize for _, k in _FIELDS)
        for kind, blob in ((r["kind"], r["blob"]) for r in rows):
            if kind == 0:
                at = 0
                for field, form in _FIELDS:
                    values, at = _from_planes(blob, at, len(blob) // size, form)
                    held[field].append(values)
            else:
                n, at = len(blob) // 24, 0
                row, at = _from_planes(blob, at, n, "<i8")
                begin, at = _from_planes(blob, at, n, "<i8")
                end, at = _from_planes(blob, at, n, "<i8")
                yield from out(row, row, np.ones(n, bool), begin, end, row, row)
        if not held["anchor"]:
            return
        f = {k: np.concatenate(v) for k, v in held.items()}
        # most anchors stand alone
        plain = np.argsort(f["anchor"], kind="stable")
        a = f["anchor"][plain]
        twin = np.zeros(len(a), bool)
        twin[1:] = a[1:] == a[:-1]
        twin[:-1] |= a[1:] == a[:-1]
        keep = plain[twin]
        f = {k: v[keep] for k, v in f.items()}
        order = np.lexsort((f["begin"], f["row"], f["doc"], f["segment"], f["anchor"]))
        f = {k: v[order] for k, v in f.items()}
        if not len(order):
            return
        same_anchor = np.concatenate([[False], f["anchor"][1:] == f["anchor"][:-1]])
        same = same_anchor & np.concatenate([[False], f["segment"][1:] == f["segment"][:-1]])
        kinds_of = np.add.reduceat((~same).astype(np.int64), np.flatnonzero(~same_anchor))
        mixed = np.repeat(kinds_of > 1, np.diff(np.append(np.flatnonzero(~same_anchor), len(order))))
        pick = same | mixed
        end = f["begin"] + f["length"]
        yield from out(f["row"][pick], f["doc"][pick], same[pick], f["begin"][pick], end[pick], f["anchor"].view(np.int64)[pick], f["offset"].astype(np.int64)[pick])

    return segments.mapInArrow(lean(run), "row long, doc long, gone boolean, begin long, end long, anchor long, offset long")


_SEGMENT = "key long, offset long, doc long, row long, begin long, bytes binary"


def _fetched(rows: DataFrame, wanted: DataFrame, crowded: bool) -> DataFrame:
    """(key, offset, doc, row, begin, bytes) of the segments in question; the key is the anchor, or, of crowded ones, the core."""
    lists = wanted.groupBy(F.col("row").alias("of_row")).agg(F.collect_list(F.struct("anchor", "offset", "begin", "end")).alias("segments"))
    joined = rows.join(lists, F.col("row") == F.col("of_row")).select("doc", "row", "segments", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            docs, numbers, lists, texts = (batch.column(k) for k in range(4))
            for doc, row, some, text in zip(docs.to_pylist(), numbers.to_pylist(), lists.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                for s in some:
                    whole = (s["anchor"], s["offset"], s["begin"], text[s["begin"] : s["end"]])
                    for key, offset, begin, stretch in cores(*whole, NEAR_DISTANCES) if crowded else [whole]:
                        for column, value in zip(out, (key, offset, doc, row, begin, stretch), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(out)], names=["key", "offset", "doc", "row", "begin", "bytes"])

    return joined.mapInArrow(lean(run), _SEGMENT)


def cores(anchor: int, offset: int, begin: int, segment: bytes, distances: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A segment's strings by distance from their beginning to the anchor, so many distances together: (key, offset, begin,
    bytes) of each stretch. The key is a hash of the anchor, of the distances and of the bytes that all strings of these
    distances hold, so equal strings have equal keys whatever segments they are in."""
    for low in range(0, LENGTH - PIECE + 1, distances):
        high = min(low + distances - 1, LENGTH - PIECE)
        first, last = max(offset - high, 0), min(offset - low, len(segment) - LENGTH)
        if first <= last:
            core = segment[offset - low : offset - high + LENGTH]
            key = xxhash.xxh64_intdigest(core, seed=(anchor + low * 0x9E3779B97F4A7C15 + distances) & (1 << 64) - 1)
            yield key - (1 << 64) if key >> 63 else key, offset - first, begin + first, segment[first : last + LENGTH]


def _told_by_hash(segments: DataFrame) -> DataFrame:
    """(row, begin, end) of the strings of crowded cores that begin earlier elsewhere: least places by distance and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for key, offset, doc, row, begin, stretch in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for one, _, at, _ in cores(key, offset, begin, stretch, 1):
                    for column, value in zip(out, (one, doc, row, at), strict=True):
                        column.append(value)
            for at in range(0, len(out[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], pa.int64()) for c in out], names=["key", "doc", "row", "begin"])

    strings = segments.mapInArrow(lean(run), "key long, doc long, row long, begin long")
    place = F.struct("doc", "row", "begin")
    first = strings.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return strings.join(first, "key").filter(place != F.col("first")).select("row", "begin", (F.col("begin") + LENGTH).alias("end"))


def shared_strings(anchor: np.ndarray, offset: np.ndarray, doc: np.ndarray, row: np.ndarray, begin: np.ndarray, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment index, start in it) of each LENGTH-byte string that a segment with the same anchor, of an earlier place, holds
    at the same distance from the anchor. Rows with one anchor stand together."""
    lengths = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    base = np.cumsum(lengths) - lengths
    phase = offset % WORD
    words_of = np.maximum((lengths - phase) // WORD, 0)
    # words of eight bytes counted from the anchor, one below all others after each segment
    spots = [b + p + WORD * np.arange(n) for b, p, n in zip(base.tolist(), phase.tolist(), words_of.tolist(), strict=True)]
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    flat = np.concatenate(spots)
    words = np.ascontiguousarray(padded[flat[:, None] + np.arange(WORD)]).view("<u8").reshape(-1)
    ranks = np.unique(words, return_inverse=True)[1] + 1
    text = np.zeros(len(ranks) + len(segments), np.int64)
    ends = np.cumsum(words_of + 1) - 1
    at = np.ones(len(text), bool)
    at[ends] = False
    text[at] = ranks
    segment = np.repeat(np.arange(len(segments)), words_of + 1)
    index = np.arange(len(text)) - np.repeat(ends - words_of, words_of + 1)
    order = suffix_array(text)
    order = order[words_of[segment[order]] - index[order] >= WHOLE_WORDS]  # suffixes that hold enough words
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alike = np.ones(len(order) - 1, bool)
    for k in range(WHOLE_WORDS):
        alike &= text[order[1:] + k] == text[order[:-1] + k]
    run = np.cumsum(np.concatenate([[0], ~alike]))
    in_run = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
    order, run = order[in_run], run[in_run]
    # all strings whose first whole word begins a suffix of a run
    shift = np.arange(WORD)
    seg = np.repeat(segment[order], WORD)
    start = (phase[segment[order]][:, None] + WORD * index[order][:, None] - shift).reshape(-1)
    group = np.repeat(run, WORD)
    fits = (start >= 0) & (start + LENGTH <= lengths[seg])
    seg, start, group = seg[fits], start[fits], group[fits]
    if not len(seg):
        return seg, start
    from_anchor = start - offset[seg]
    hasher = Hasher(_BASE_SEGMENT)
    spot = base[seg] + start
    hashed = hasher.of(hasher.sums(data), spot, spot + LENGTH)
    keys = np.lexsort((begin[seg], row[seg], doc[seg], hashed, from_anchor, anchor[seg], group))
    seg, start, group, hashed, from_anchor, spot = (x[keys] for x in (seg, start, group, hashed, from_anchor, spot))
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (anchor[seg][1:] != anchor[seg][:-1]) | (from_anchor[1:] != from_anchor[:-1]) | (hashed[1:] != hashed[:-1])])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = np.flatnonzero(~new)
    equal = np.ones(len(later), bool)
    for cut in range(0, len(later), 100_000):  # the bytes themselves
        some = later[cut : cut + 100_000]
        equal[cut : cut + 100_000] = (data[spot[some][:, None] + np.arange(LENGTH)] == data[spot[leader[some]][:, None] + np.arange(LENGTH)]).all(1)
    return seg[later[equal]], start[later[equal]]


def _compared(fetched: DataFrame) -> DataFrame:
    """(row, begin, end) to remove, from segments dealt by key (anchor or core) and sorted by it, in blocks of whole groups."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        anchor, offset, doc, row, begin = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        seg, start = shared_strings(anchor, offset, doc, row, begin, [r[5] for r in rows])
        of, at = row[seg], begin[seg] + start
        order = np.lexsort((at, of))
        r, b, e = _joined(of[order], at[order], at[order] + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int64())], names=["row", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if size >= BLOCK_BYTES and r[0] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[5]), r[0]
        if held:
            yield settle(held)

    return fetched.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "row long, begin long, end long")


def repeats(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """The numbered rows of docs, and (row, begin, end) of what to remove from them; stretches may overlap."""
    short_batches(docs.sparkSession)
    rows, size = _numbered(docs)
    settled = materialize(_settled(_segments(rows, parts_for(FACT_SHARE * size, PART_BYTES))), "settled")
    wanted = settled.filter(~F.col("gone")).select("row", "anchor", "offset", "begin", "end")
    crowded = materialize(wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("anchor"), "crowded")
    if crowded.isEmpty():
        compared = _compared(_fetched(rows, wanted, False))
    else:
        few = F.broadcast(crowded) if small_enough(crowded, row_bytes=32) else crowded
        split = materialize(_fetched(rows, wanted.join(few, "anchor", "left_semi"), True), "split")
        full = materialize(split.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("key"), "crowded-cores")
        full = F.broadcast(full) if small_enough(full, row_bytes=32) else full
        alone = _fetched(rows, wanted.join(few, "anchor", "left_anti"), False).union(split.join(full, "key", "left_anti").select(split.columns))
        compared = _compared(alone).union(_told_by_hash(split.join(full, "key", "left_semi").select(split.columns)))
    return rows, settled.filter("gone").select("row", "begin", "end").unionByName(compared)


def dedup(docs: DataFrame, with_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left) of every row of docs.

    Removed is each byte that a 100-byte string covers which also begins earlier: in a row of smaller doc_id, or sooner
    in the same one; strings are those of the input, and none crosses rows. Rows are numbered by their place in the files of
    docs (a frame that isn't read from files is written first), so another division into tasks changes nothing. Null texts
    are empty; null ids come before all others; rows of one id count in the table's order (files by name); an empty table
    gives no rows; other columns aren't read.
    """
    rows, gone = repeats(docs, crowd)
    lists = gone.groupBy(F.col("row").alias("of_row")).agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    joined = rows.select("doc_id", "row", "text").join(lists, F.col("row") == F.col("of_row"), "left").select("doc_id", "gone", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            begins, ends = (pa.compute.list_flatten(batch.column(1)).field(k).to_numpy(zero_copy_only=False) for k in ("begin", "end"))
            counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            for n, text in zip(counts.tolist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                b, e = begins[at : at + n], ends[at : at + n]
                at += n
                order = np.argsort(b, kind="stable")
                _, b, e = _joined(np.zeros(n, np.int64), b[order].astype(np.int64), e[order].astype(np.int64))
                left, done = [], 0
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    left.append(text[done:x])
                    done = y
                left.append(text[done:])
                kept = b"".join(left)
                for column, value in zip(out, (len(text), len(text) - len(kept), len(b), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(columns if with_text else columns[:-1], names=names if with_text else names[:-1])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return joined.mapInArrow(lean(run), schema)
