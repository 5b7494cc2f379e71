"""TIFF columns: walks image directories, undoes PackBits, LZW or deflate in strips or tiles and the horizontal predictor,
and gives one row per page. Also writes such files, for tables whose bytes are to be kept as images.

Work is a pure map over rows in Arrow batches: nothing is shuffled, and a task holds one batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, text_or_empty

# Fixed values of the format: tags, compressions, bytes of each field type, LZW's codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
CLEAR, END, FIRST_CODE = 256, 257, 258
LAST_CODE = 4094


def _width_schedule() -> np.ndarray:
    """Bits of the k-th code after a clear code: the width grows one code before the table needs it."""
    entries = FIRST_CODE + np.maximum(np.arange(LAST_CODE - FIRST_CODE + 4) - 1, 0)
    return np.where(entries < 511, 9, np.where(entries < 1023, 10, np.where(entries < 2047, 11, 12)))


WIDTHS = _width_schedule()
STARTS = np.concatenate([[0], np.cumsum(WIDTHS)])


SINGLES = [bytes([i]) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits from a table that is cleared when full; an entry's key is its prefix's code and last byte."""
    codes, widths, schedule = [CLEAR], [9], WIDTHS.tolist()
    table: dict[int, int] = {}
    prefix, fill, since = -1, FIRST_CODE, 0
    for value in data:
        key = (prefix << 8) | value
        longer = table.get(key)
        if longer is not None:
            prefix = longer
        elif prefix < 0:
            prefix = value
        else:
            codes.append(prefix)
            widths.append(schedule[since])
            since += 1
            table[key] = fill
            fill += 1
            prefix = value
            if fill == LAST_CODE:
                codes.append(CLEAR)
                widths.append(schedule[since])
                table, fill, since = {}, FIRST_CODE, 0
    if prefix >= 0:
        codes.append(prefix)
        widths.append(schedule[since])
        since += 1
    codes.append(END)
    widths.append(schedule[since])
    return _pack_codes(np.array(codes, np.uint32), np.array(widths, np.int64))


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of 9 to 12 bits one after another, most significant bit first."""
    bits = ((codes[:, None] >> np.arange(11, -1, -1)) & 1).astype(np.uint8)
    keep = np.arange(12) >= 12 - widths[:, None]
    return np.packbits(bits[keep]).tobytes()


def lzw_decode(data: bytes) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at, out = 8 * len(data), 0, []
    while at + 9 <= total:
        # all codes up to the next clear code have known widths and so known places
        starts = at + STARTS[:-1]
        n = int(np.searchsorted(starts + WIDTHS, total, side="right"))
        starts, widths = starts[:n], WIDTHS[:n].astype(np.uint32)
        byte = starts >> 3
        word = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
        codes = (word >> (24 - widths - (starts & 7).astype(np.uint32))) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else n
        out.append(_expand(codes[:n].tolist()))
        if not len(stop) or codes[n] == END:
            break
        at = int(starts[n] + widths[n])
    return b"".join(out)


def _expand(codes: list[int]) -> bytes:
    if not codes:
        return b""
    table = [*SINGLES, b"", b""]
    append, last = table.append, table[codes[0]]
    parts = [last]
    for code in codes[1:]:
        if code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code stands before its entry")
        parts.append(entry)
        append(last + entry[:1])
        last = entry
    return b"".join(parts)


def packbits_encode(row: bytes) -> bytes:
    """Runs of three or more equal bytes as a repeat, everything else as literals of up to 128."""
    if not row:
        return b""
    values = np.frombuffer(row, np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    runs = bounds[1:] - bounds[:-1]
    out, done = [], 0

    def literals(upto: int) -> None:
        for at in range(done, upto, 128):
            piece = row[at : min(at + 128, upto)]
            out.append(SINGLES[len(piece) - 1] + piece)

    for k in np.flatnonzero(runs >= 3).tolist():
        literals(int(bounds[k]))
        left = int(runs[k])
        while left > 1:
            n = min(left, 128)
            out.append(SINGLES[257 - n] + row[bounds[k] : bounds[k] + 1])
            left -= n
        done = int(bounds[k + 1]) - left
    literals(len(row))
    return b"".join(out)


def packbits_decode(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


def _shrink(rows: np.ndarray, compression: int, predictor: int) -> bytes:
    """rows: (height, width, samples) of one strip or tile."""
    if predictor == 2:
        rows = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1)
    if compression == PACKBITS:
        return b"".join(packbits_encode(r.tobytes()) for r in rows)
    data = rows.tobytes()
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6) if compression in (DEFLATE, OLD_DEFLATE) else data


def _restore(data: bytes, shape: tuple[int, int, int], dtype: np.dtype, compression: int, predictor: int) -> np.ndarray:
    if compression == LZW:
        data = lzw_decode(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif compression == PACKBITS:
        data = packbits_decode(data)
    elif compression != NONE:
        raise ValueError(f"compression {compression} isn't known")
    rows = np.frombuffer(data, dtype, count=int(np.prod(shape))).reshape(shape)
    return np.cumsum(rows, axis=1, dtype=rows.dtype) if predictor == 2 else rows


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = 256) -> bytes:
    """A little-endian file of 8-bit pages, each (height, width, samples), in strips or in square tiles (a multiple of 16)."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for page in pages:
        height, width, samples = page.shape
        offsets, counts = [], []
        if tile:
            across, down = -(-width // tile), -(-height // tile)
            padded = np.zeros((down * tile, across * tile, samples), np.uint8)
            padded[:height, :width] = page
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, down * tile, tile) for x in range(0, across * tile, tile)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        for part in parts:
            data = _shrink(part, compression, predictor)
            offsets.append(len(out)), counts.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        if not tile:
            fields += [(STRIP_OFFSETS, 4, offsets)]
        fields += [(SAMPLES, 3, [samples])]
        if not tile:
            fields += [(ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, counts)]
        fields += [(PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in fields:
            packed = struct.pack(f"<{len(values)}{FIELD_CODE[kind]}", *values)
            if len(packed) > 4:
                where = struct.pack("<I", len(out))
                out += packed
                out += b"\0" * (len(out) % 2)
            else:
                where = packed.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + where
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """The directory at a place: tag to values, and the place of the next directory."""
    (count,) = struct.unpack_from(order + "H", data, at)
    found: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in FIELD_CODE:
            continue
        place = at + 10 + 12 * k
        if n * FIELD_BYTES[kind] > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        found[tag] = struct.unpack_from(f"{order}{n}{FIELD_CODE[kind]}", data, place)
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def decode(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Each page's facts and pixels (height, width, samples). Raises ValueError or struct.error on a broken file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, at = _fields(data, order, at)
        width, height, samples = tags[WIDTH][0], tags[LENGTH][0], tags.get(SAMPLES, (1,))[0]
        bits = tags.get(BITS, (1,))
        if set(bits) - {8, 16}:
            raise ValueError(f"{bits} bits a sample aren't supported")
        dtype = np.dtype("u1" if bits[0] == 8 else order + "u2")
        compression, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
        planes = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
        deep = 1 if planes > 1 else samples
        page = np.zeros((height, width, samples), dtype.newbyteorder("="))
        tiled = TILE_OFFSETS in tags
        if tiled:
            tall, wide = tags[TILE_LENGTH][0], tags[TILE_WIDTH][0]
            offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
        else:
            tall, wide = min(tags.get(ROWS_PER_STRIP, (height,))[0], height), width
            offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        places = [(p, y, x) for p in range(planes) for y in range(0, height, tall or 1) for x in range(0, width, wide)]
        for (plane, y, x), place, size in zip(places, offsets, counts, strict=True):
            rows = tall if tiled else min(tall, height - y)
            part = _restore(data[place : place + size], (rows, wide, deep), dtype, compression, predictor)
            part = part[: height - y, : width - x]
            page[y : y + part.shape[0], x : x + part.shape[1], plane : plane + deep] = part
        facts = {"width": width, "height": height, "samples": samples, "bits": bits[0], "compression": compression, "predictor": predictor, "tiled": tiled}
        yield facts, page


PAGES_SCHEMA = (
    "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, "
    "pixels binary, mean double, error string"
)


def pages(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each TIFF file, with the kept columns before the page's own.

    A null or broken file gives one row with page -1 and the error's text (pages read before a fault stay). Repeated
    files are repeated; kept columns may not have the names of the page's columns.
    """
    own = [f.split()[0] for f in PAGES_SCHEMA.split(", ")]
    if clash := set(keep) & set(own):
        raise ValueError(f"these columns have the names of page columns: {sorted(clash)}")
    source = files.select(*keep, F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                kept, page = list(row[:-1]), -1
                try:
                    if row[-1] is None:
                        raise ValueError("no content")
                    for page, (facts, pixels) in enumerate(decode(row[-1])):
                        yield pd.DataFrame([[*kept, page, *facts.values(), pixels.tobytes(), float(pixels.mean() if pixels.size else 0), None]], columns=[*keep, *own])
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as error:
                    empty = [None] * (len(own) - 2)
                    yield pd.DataFrame([[*kept, -1, *empty, str(error)]], columns=[*keep, *own])

    kept = [f"`{n}` {source.schema[n].dataType.simpleString()}" for n in keep]
    return source.mapInPandas(run, ", ".join([*kept, PAGES_SCHEMA]))


#: Text payloads: bytes of a pixel row (64 RGB pixels), rows of a page.
ROW_BYTES, PAGE_ROWS = 192, 1024
#: A payload's form by its crc32: compression, predictor, tile side.
FORMS = (
    (NONE, 1, 0), (PACKBITS, 1, 0), (LZW, 1, 0), (DEFLATE, 2, 0),
    (NONE, 1, 16), (LZW, 1, 16), (DEFLATE, 1, 0), (DEFLATE, 2, 32),
)


def store_payload(text: bytes) -> tuple[bytes, bytes]:
    """Payload and TIFF file of a text: padded with spaces to whole pixel rows, one page for each 1024 rows."""
    payload = text + b" " * (-len(text) % ROW_BYTES if text else ROW_BYTES)
    compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    parts = [pixels[y : y + PAGE_ROWS] for y in range(0, len(pixels), PAGE_ROWS)]
    return payload, encode(parts, compression, predictor, tile)


def feature_of(stored: list[np.ndarray]) -> str:
    """Facts of the samples read back: pages, mean, deviation, entropy in bits and edge energy."""
    flat = np.concatenate([p.reshape(-1) for p in stored])
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / flat.size
    edges = np.abs(np.diff(flat.astype(np.int16))).mean()
    return f"pages={len(stored)};mean={flat.mean():.4f};sd={flat.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};edge={edges:.4f}"


def text_media(docs: DataFrame) -> DataFrame:
    """Keeps each text as a TIFF, reads it back and describes it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes read back), media_bytes,
    media_sha256, feature, n_pages. Null text is empty (192 spaces); null ids and repeated rows are kept; equal texts
    give equal values; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                _, media = store_payload(text)
                stored = [pixels for _, pixels in decode(media)]
                back = b"".join(p.tobytes() for p in stored)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(stored), len(stored)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(lean(run), schema)
