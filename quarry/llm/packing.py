"""Best-fit-decreasing packing of token sequences into training windows.

Each partition packs its own documents: no shuffle, and nothing grows with the table but the number of tasks. Documents
are tokenised, given an end id and cut into full windows; what is left of each (under one window) goes, longest first,
into the open window with the least room that still holds it, found by a segment tree indexed by remaining capacity.
"""

from __future__ import annotations

import functools
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, release, short_batches, text_or_empty

CAPACITY = 2048
END_ID = 1
#: Documents packed together at most: bounds a task's memory whatever its partition holds.
BLOCK_DOCS = 50_000
#: Bytes of ids in such a block at most, but for one document. They are held only if asked for.
BLOCK_BYTES = 128 << 20
#: Bytes of texts that are encoded together.
LOT_BYTES = 1 << 20
#: Distinct words whose ids a worker keeps; beyond them, only those of the texts at hand stay.
CACHE_WORDS = 150_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "ids binary"
)


class RoomTree:
    """A segment tree over remaining capacities 0..capacity; each leaf holds a stack of open windows."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.leaves
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least need."""
        node, filled = need + self.leaves, self.filled
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            filled[node] = 0
            node >>= 1
            while node and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
                node >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows. Lengths are 1..capacity; ties go in input order."""
    windows, offsets, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    tree = RoomTree(capacity)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = tree.take_tightest(need)
        if found is None:
            found = (capacity, count)
            count += 1
        room, window = found
        windows[piece], offsets[piece] = window, capacity - room
        if room > need:
            tree.add(room - need, window)
    return windows, offsets, count


@functools.cache
def parts_from_marks(char: str) -> bool:
    """Whether it is a letter or digit, and still ends in one when composed and lower-cased (dotted I ends in its dot)."""
    return char.isalnum() and unicodedata.normalize("NFC", char).lower()[-1].isalnum()


class WordIds:
    """Ids of whole texts by way of their words. The vocabulary's words end at white space, and a run of letters is
    never joined with what stands beside it; so each distinct word is encoded once, and texts are put together from
    their words' ids. A text with a special token's opening is encoded as a whole."""

    SPECIAL = "<|"  # fixed value: how the vocabulary's special tokens begin
    WORD_END = "</w>"  # fixed value: how tokens that end a word end
    TAIL = string.punctuation.replace("'", "")  # an apostrophe may begin an ending of its own, as in 's
    JOINED = 64  # words of letters that are encoded side by side

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # no word comes twice
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith(self.WORD_END)
        release()  # of the file and its tokens
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters alone: encoded side by side, and told apart by the tokens that end words."""
        lots = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        for lot, raw in zip(lots, self._whole([" ".join(lot) for lot in lots]), strict=True):
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            if len(ends) == len(lot):
                self.known.update(zip(lot, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:  # lower-casing or composition made another number of words
                self.known.update(zip(lot, self._whole(lot), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Adds words; a word with a letter or digit before closing marks is put together from the two."""
        known, letters, others, joint = self.known, {}, {}, []
        for word in words:
            stem = word.rstrip(self.TAIL)
            if len(stem) < len(word) and parts_from_marks(stem[-1:]):
                tail = word[len(stem) :]
                joint.append((word, stem, tail))
                if tail not in known:
                    others[tail] = None
                if stem in known:
                    continue
            else:
                stem = word
            (letters if stem.isalpha() else others)[stem] = None
        known.update(zip(others, self._whole(list(others)), strict=True))
        self._learn_letters(list(letters))
        for word, stem, tail in joint:
            known[word] = known[stem] + known[tail]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, little-endian. The texts' distinct words are looked up once, and their ids dealt by numpy."""
        special = pc.match_substring(texts, self.SPECIAL)
        words = pc.ascii_split_whitespace(pc.if_else(special, "", texts))
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known = {w: x for w, x in zip(distinct, found, strict=True) if x is not None}
            self._learn([w for w, x in zip(distinct, found, strict=True) if x is None])
            found = [self.known[w] if x is None else x for w, x in zip(distinct, found, strict=True)]
        pool, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int32)
        at = coded.indices.to_numpy()
        each, first = sizes[at], (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
        stops = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        ids = pool[np.repeat(first - stops[:-1], each) + np.arange(stops[-1])].tobytes()
        bounds = (4 * stops[words.offsets.to_numpy() - words.offsets[0].as_py()]).tolist()
        for k, whole in enumerate(special.to_pylist()):
            yield self._whole([texts[k].as_py()])[0] if whole else ids[bounds[k] : bounds[k + 1]]

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all(pa.array([text.decode()])))


def lots_of(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of so many bytes together at most, but for one text."""
    lengths = pc.binary_length(texts).to_pylist()
    begin = size = 0
    for at, n in enumerate(lengths):
        if at > begin and size + n > most:
            yield texts[begin:at]
            begin, size = at, 0
        size += n
    if begin < len(lengths):
        yield texts[begin:]


def pieces_of(
    batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, end: bytes, with_ids: bool, first: int
) -> Iterator[pa.RecordBatch]:
    """The packed pieces of batches of (doc_id, text), in windows numbered from first. Unless they are asked for, ids are
    counted and then dropped, so that only the pieces' numbers wait for the block's end."""
    words, number, size, count = WordIds(tokenizer_path), first, 0, 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in (*names, "sequence_id", "offset")] + [("ids", pa.binary())] * with_ids)
    held: dict[str, list] = {n: [] for n in names + ["ids"] * with_ids}

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        windows, offsets, opened = best_fit_decreasing(np.array(held["length"], np.int64), capacity)
        columns = held | {"sequence_id": windows + number, "offset": offsets}
        number += opened
        for at in range(0, len(windows), 4000):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][at : at + 4000], f.type) for f in schema], schema=schema)
        for column in held.values():
            column.clear()

    for batch in batches:
        encoded = (ids for lot in lots_of(batch.column(1), LOT_BYTES) for ids in words.encode_all(lot))
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
            ids += end
            for start in range(0, len(ids), 4 * capacity):
                piece = ids[start : start + 4 * capacity]
                row = (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)
                for column, value in zip(held.values(), row, strict=False):
                    column.append(value)
            size, count = size + len(ids), count + 1
            if count >= BLOCK_DOCS or size > BLOCK_BYTES:
                yield from flush()
                size = count = 0
    if count:
        yield from flush()


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Sequence ids are the task's number times 2**33 plus a count, so they are unique and the same on a rerun of a lost
    task. Null text is empty: its document is one piece, the end id alone. Repeated rows are packed once each, a null
    doc_id is kept, other columns are not read, and an empty table gives no rows. Full windows never mix documents.
    """
    short_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first = (context.partitionId() if context else 0) << 33
        yield from pieces_of(batches, tokenizer_path, capacity, end, with_ids, first)

    schema = SCHEMA if with_ids else SCHEMA.replace(", ids binary", "")
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(lean(run), schema)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens and the share of padding when each sequence is padded to capacity."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"), (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("padding"))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Whole windows of ids from pieces made with ids: sequence_id, ids (capacity of them) and n_ids before padding."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in pdf.sort_values("offset")["ids"]])
        full = np.full(capacity, pad_id, np.int64)
        full[: len(ids)] = ids
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [full], "n_ids": [len(ids)]})

    return pieces.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, n_ids long")
