"""Toxicity of texts written to escape filters: a noisy-channel decoder restores words, then learned evidence scores them.

A character trigram model counts all documents. Words with leetspeak, inner separators, stretched letters or spaced-out
letters become lattices of what each character may stand for; Viterbi search under the model picks the restored word.
Evidence of words and word beginnings is their log odds over all labelled training rows, kept if a fixed share of the
toxic ones has them, which bounds its size whatever the corpus; a logistic curve over a bounded sample of labelled rows
turns a document's evidence into a score. Texts are scored where they lie: nothing of them is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_hash_mod, fresh, lean, quoted, release, short_batches, small_enough, text_or_empty

FOLDS, HELD_OUT = 5, 0
#: A feature must stand in this share of the toxic training rows, and in so many, with at least this log odds.
SHARE, LEAST, LOG_ODDS = 0.005, 3, 2.5
#: Labelled rows, by least hash of the id, that the logistic curve is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
TOP_WORDS = 3
CACHE_WORDS = 100_000
#: Words of more characters are decoded anew each time.
CACHED_LENGTH = 64

# What a character of an obfuscated word may stand for, besides itself if it is a letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h",
}
SEPARATORS = "._-*~'`^/\\, "
#: Log probabilities of the channel: a letter (or the end of a word) as itself, as a leet character, an inserted separator, a repeated letter.
KEEP, WRITE_LEET, INSERT, REPEAT = math.log(0.9), math.log(0.08), math.log(0.3), math.log(0.4)

#: Model alphabet: 0 is everything between words, 1..26 are a..z, 27 is any other letter.
SYMBOLS = 28
_CODE_OF_BYTE = np.zeros(256, np.int32)
_CODE_OF_BYTE[97:123] = np.arange(1, 27)
_CODE_OF_BYTE[65:91] = np.arange(1, 27)
_CODE_OF_BYTE[128:] = 27

_EDGE = re.compile(r"^[^\w@$!|+]+|[^\w@$]+$")
_SUSPECT = re.compile(r"[a-z][^\w\s]+[a-z]|[a-z][0-9@$!|+(<#€£]|[0-9@$!|+(<#€£][a-z]|([a-z])\1\1|_")
_SPACED = re.compile(r"(?<!\S)(?:[a-z0-9@$!|+] ){2,}[a-z0-9@$!|+](?!\S)")


def char_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, as an array of SYMBOLS ** 3; its size doesn't depend on the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                code = _CODE_OF_BYTE[np.frombuffer(b"  " + text + b" ", np.uint8)]
                index = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
                total += np.bincount(index, minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(lean(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # SYMBOLS ** 3 at most
    counts = np.zeros(SYMBOLS**3)
    for row in rows:
        counts[row["at"]] = row["n"]
    return counts


def char_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two: trigrams mixed with bigrams and single symbols."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi = tri.sum(axis=0)
    uni = (bi.sum(axis=0) + 1) / (bi.sum() + SYMBOLS)
    two = (bi + 5 * uni) / (bi.sum(axis=1, keepdims=True) + 5)
    three = (tri + 5 * two[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(three)


class Decoder:
    """Viterbi search for the likeliest words that a string was written for."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def restore(self, word: str) -> str:
        """word is lower-case. A separator may end a word, which gives a space. Strings without a reading come back as they are."""
        # state: the last two symbols; value: log probability and the letters so far, last first, as nested pairs
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        previous = ""
        for char in word:
            letters = char if char.isalpha() else ""
            options = [(x, KEEP, ord(x) - 96 if "a" <= x <= "z" else 27) for x in letters] + [(x, WRITE_LEET, ord(x) - 96) for x in LEET.get(char, "")]
            apart = char in SEPARATORS or not (char.isalnum() or char in LEET)
            if apart:
                options.append((" ", KEEP, 0))
            skip = INSERT if apart else REPEAT if char == previous else None
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, text) in best.items():
                if skip is not None and p + skip > new.get((a, b), (-1e18,))[0]:
                    new[a, b] = (p + skip, text)
                row = self.model[a][b]
                for letter, cost, code in options:
                    score = p + cost + row[code]
                    if score > new.get((b, code), (-1e18,))[0]:
                        new[b, code] = (score, (text, letter))
            if not new:
                return word
            best, previous = new, char
        text = max(((p + self.model[a][b][0], text) for (a, b), (p, text) in best.items()), key=lambda x: x[0])[1]
        out = []
        while text is not None:
            text, letter = text
            out.append(letter)
        return "".join(reversed(out)) or word


def is_suspect(word: str) -> bool:
    return _SUSPECT.search(word) is not None


def readings(word: str, decoder: Decoder) -> list[str]:
    """The words that a lower-case string without blanks stands for: one if it is plain; if restored as several, also all joined."""
    plain = _EDGE.sub("", word)
    if not is_suspect(plain):
        return [plain] if plain else []
    found = list(dict.fromkeys(decoder.restore(plain).split()))
    return found if len(found) < 2 else [*found, "".join(found)]


def restored_words(text: str, decoder: Decoder, known: dict[str, list[str]]) -> set[str]:
    """The distinct lower-case words of a text, obfuscated ones restored; known caches words."""
    text = text.lower()
    words = set(text.split())
    if _SPACED_HINT.search(text):
        words.update(m.group().replace(" ", ".") for m in _SPACED.finditer(text))
    out = set()
    for word in words:
        found = known.get(word)
        if found is None:
            found = readings(word, decoder)
            if len(known) > CACHE_WORDS:
                known.clear()
            if len(word) <= CACHED_LENGTH:
                known[word] = found
        out.update(found)
    return out


_SPACED_HINT = re.compile(r" [a-z0-9@$!|+] [a-z0-9@$!|+] ")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, each with its length as a mark."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]


class Model(NamedTuple):
    chars: np.ndarray
    evidence: dict[str, float]
    slopes: tuple[float, ...]
    offset: float


class Scorer:
    """Scores texts in one worker; evidence of words is cached, up to a bound."""

    def __init__(self, chars: np.ndarray, evidence: dict[str, float]):
        self.decoder, self.evidence = Decoder(chars), evidence
        self.known: dict[str, tuple[float, ...]] = {}

    def _of_word(self, word: str) -> tuple[float, ...]:
        """Evidence of each word that a string stands for; of all joined only if they have none."""
        each = [max(self.evidence.get(f, 0.0) for f in features_of(x)) for x in readings(word, self.decoder)]
        apart = each[:-1] if len(each) > 1 else each
        return tuple(e for e in apart if e) or tuple(e for e in each if e)

    def measure(self, text: str) -> tuple[float, ...]:
        """Evidence of the strongest words, strongest first; 0 where there are none."""
        text = text.lower()
        words = set(text.split())
        if _SPACED_HINT.search(text):
            words.update(m.group().replace(" ", ".") for m in _SPACED.finditer(text))
        known, strong = self.known, []
        for word in words:
            e = known.get(word)
            if e is None:
                if len(known) > CACHE_WORDS:
                    known.clear()
                e = self._of_word(word)
                if len(word) <= CACHED_LENGTH:
                    known[word] = e
            strong += e
        strong.sort(reverse=True)
        return tuple((strong + [0.0] * TOP_WORDS)[:TOP_WORDS])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled training rows; of several labels of an id the highest holds."""
    train = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(doc_hash_mod(FOLDS) != HELD_OUT)
    train = train.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = F.broadcast(train) if small_enough(train, row_bytes=32) else train
    return docs.select("doc_id", text_or_empty().alias("text")).join(few, "doc_id")


def _feature_counts(texts: DataFrame, chars, only) -> DataFrame:
    """(feature, n): in how many of the texts a feature stands; only, if given, is a broadcast set of what is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known, seen = Decoder(chars.value), {}, Counter()
        wanted = None if only is None else only.value

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {f for w in restored_words(text, decoder, known) for f in features_of(w)}
                seen.update(found if wanted is None else found & wanted)
            if len(seen) > 300_000:
                yield flush()
                seen.clear()
        yield flush()

    return texts.select("text").mapInArrow(lean(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve over columns of x, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1]), x.T @ (p - y) + ridge * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from all documents (characters) and from the labelled rows outside the held-out fold (evidence, curve)."""
    short_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    chars = char_model(char_trigrams(docs))
    shared = context.broadcast(chars)
    rows = _labelled(docs, labels)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model(chars, {}, (0.0,) * TOP_WORDS, -3.0)
    least = max(LEAST, math.ceil(SHARE * toxic))
    # features in a fixed share of rows: at most (mean features a row / share) of them
    often = {r["feature"]: r["n"] for r in _feature_counts(rows.filter("toxic > 0"), shared, None).filter(F.col("n") >= least).collect()}
    wanted = context.broadcast(frozenset(often))
    other = {r["feature"]: r["n"] for r in _feature_counts(rows.filter("toxic = 0"), shared, wanted).collect()}
    evidence = {}
    for feature, n in often.items():
        odds = math.log((n + 0.5) / (toxic + 1)) - math.log((other.get(feature, 0) + 0.5) / (clean + 1))
        if odds >= LOG_ODDS:
            evidence[feature] = odds
    model = Model(chars, evidence, (0.0,) * TOP_WORDS, -3.0)
    measured = rows.select("doc_id", "toxic", _measure(context.broadcast(model))("text").alias("m")).select("toxic", F.xxhash64("doc_id").alias("h"), "m.*")
    sample = measured.orderBy("h").limit(SAMPLE).toPandas()
    x = np.column_stack([*(sample[c] for c in _COLUMNS), np.ones(len(sample))])
    w = fit_curve(x, (sample["toxic"] > 0).to_numpy(float))
    return model._replace(slopes=tuple(w[:-1].tolist()), offset=float(w[-1]))


_COLUMNS = [f"e{k}" for k in range(TOP_WORDS)]


def _measure(model):
    @F.pandas_udf(", ".join(f"{c} double" for c in _COLUMNS))
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value.chars, model.value.evidence)
        try:
            for part in parts:
                yield pd.DataFrame([scorer.measure(t) for t in part], columns=_COLUMNS)
        finally:
            del scorer
            release()

    return measure


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of a text, 0 to 1; a null text is empty."""
    m = _measure(docs.sparkSession.sparkContext.broadcast(model))(F.coalesce(F.col(quoted(text)), F.lit("")))
    total = sum((m[c] * w for c, w in zip(_COLUMNS, model.slopes, strict=True)), F.lit(model.offset))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Only text makes the score. Null texts are empty and score as such; null ids stay, in the fold of empty text; repeated
    rows score alike; without labels of both kinds nothing counts as evidence, and every score is low; an empty
    table gives no rows.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", (doc_hash_mod(FOLDS) == HELD_OUT).alias("held_out"), score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all its columns stay as they are."""
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, score_column(docs, train(docs, labels))).filter(F.col(name) < THRESHOLD).drop(name)
