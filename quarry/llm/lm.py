"""A log-bilinear language model, trained by noise-contrastive estimation where the data lies, and its token scores.

Words are counted over all training documents. The most frequent ones have vectors of their own; all others have those of
their class, which is told by their last letters and within which a word's probability follows its count (unseen words
share one further place), so that every token is predicted from its context, and token probabilities sum to one over an
open vocabulary. Each round, every task trains a copy of the model on its own documents, and the copies
are averaged by weight in blocks of parameters. The prediction is linear in the two context words, so the normaliser of
every context is one product of two matrices of exponentials.

Counts of words outside a bounded head are joined, not broadcast; no document leaves its task but for such words.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_hash_mod, lean, materialize, short_batches, text_or_empty

FOLDS, HELD_OUT = 7, 2
#: Words with vectors of their own, classes of all other words, and words whose counts every worker holds. The tables of
#: normalisers have (1 + SHORTLIST + CLASSES) ** 2 entries in each worker.
SHORTLIST, CLASSES, HEAD = 1279, 768, 200_000
#: Last bytes of a word that tell its class.
ENDING = 3
DIM, CONTEXT = 24, 2
NOISE, BATCH, BUFFER = 64, 2048, 1 << 18
#: Share of the training documents and learning rate of each round; the shares cover them all once.
ROUNDS = ((1 / 8, 0.03), (3 / 8, 0.03), (1 / 2, 0.02))
#: Parameters in a block, and copies averaged together at first.
BLOCK, FAN_IN = 8192, 256
#: Distinct words that a counting task holds before it passes them on.
FLUSH_WORDS = 400_000

END = 0  # id of the end token (also what stands before a text); classes follow it, then the shortlist's words


def class_id(word: bytes) -> int:
    """The id of a word outside the shortlist."""
    return 1 + zlib.crc32(word[-ENDING:]) % CLASSES


def _class_of(token: Column) -> Column:
    """Which class, from 0 on, a word (a string) would be in; the same as class_id, less one."""
    return (F.crc32(F.substring(token.cast("binary"), -ENDING, ENDING)) % CLASSES).cast("int")


class Params(NamedTuple):
    words: np.ndarray  # context vectors, (ids, dim)
    outputs: np.ndarray  # predicted vectors, (ids, dim)
    mix: np.ndarray  # weights of each context place, (context, dim)
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self])

    def like(self, flat: np.ndarray) -> Params:
        parts, at = [], 0
        for x in self:
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Params(*parts)


def fresh_params(noise: np.ndarray, dim: int = DIM, seed: int = 7) -> Params:
    """Small random vectors, and the log of the noise distribution as bias."""
    draw = np.random.default_rng(seed)
    n = len(noise)
    mix = np.full((CONTEXT, dim), 0.5)
    return Params(*(x.astype(np.float32) for x in (draw.normal(0, 0.1, (n, dim)), draw.normal(0, 0.1, (n, dim)), mix, np.log(noise))))


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps on one copy of the model."""

    def __init__(self, params: Params, noise: np.ndarray, rate: float, seed: int):
        self.p = Params(*(x.copy() for x in params))
        self.sums = Params(*(np.full_like(x, 0.1) for x in params))
        self.draw = np.random.default_rng(seed)
        self.cumulative, self.rate = np.cumsum(noise), rate
        self.log_noise = np.log(noise * NOISE).astype(np.float32)

    def _step(self, name: int, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        x, g2 = self.p[name], self.sums[name]
        if rows is None:
            g2 += grad * grad
            x += self.rate * grad / np.sqrt(g2)
            return
        # gradients of equal rows are summed first
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, rows = np.add.reduceat(grad[order], starts, axis=0), rows[starts]
        g2[rows] += total * total
        x[rows] += self.rate * total / np.sqrt(g2[rows])

    def batch(self, target: np.ndarray, context: list[np.ndarray]) -> None:
        p = self.p
        near = [p.words[c] for c in context]
        guess = sum(x * m for x, m in zip(near, p.mix, strict=True))
        noise = np.searchsorted(self.cumulative, self.draw.random(NOISE) * self.cumulative[-1]).clip(0, len(self.cumulative) - 1).astype(np.int16)
        right, wrong = p.outputs[target], p.outputs[noise]
        up = 1 - _sigmoid(np.einsum("ij,ij->i", guess, right) + p.bias[target] - self.log_noise[target])
        down = -_sigmoid(guess @ wrong.T + p.bias[noise] - self.log_noise[noise])
        back = up[:, None] * right + down @ wrong
        self._step(1, np.concatenate([up[:, None] * guess, down.T @ guess]), np.concatenate([target, noise]))
        self._step(3, np.concatenate([up, down.sum(0)]), np.concatenate([target, noise]))
        mix = np.stack([np.einsum("ij,ij->j", x, back) for x in near])
        self._step(0, np.concatenate([back * m for m in p.mix]), np.concatenate(context))
        self._step(2, mix)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; the end token is not in the list."""
    return text.lower().split()


def _stream(ids: list[list[int]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Targets, contexts (nearest first) and number of tokens of each text; each text ends with END."""
    lengths = np.array([len(x) + 1 for x in ids])
    flat = np.full(int(lengths.sum()) + CONTEXT * len(ids), END, np.int16)
    begins = np.concatenate([[0], np.cumsum(lengths + CONTEXT)[:-1]])
    is_target = np.ones(len(flat), bool)
    for k in range(CONTEXT):
        is_target[begins + k] = False
    for begin, text in zip(begins.tolist(), ids, strict=True):
        flat[begin + CONTEXT : begin + CONTEXT + len(text)] = text
    at = np.flatnonzero(is_target)
    return flat[at], [flat[at - 1 - k] for k in range(CONTEXT)], lengths


def count_words(docs: DataFrame) -> DataFrame:
    """(token, n) over the whole texts of docs; the end token, once for each text, is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text in texts:
                seen.update(tokens_of(text))
            seen[b""] += len(texts)
            if len(seen) > FLUSH_WORDS:
                yield flush()
                seen.clear()
        yield flush()

    return docs.select(text_or_empty().alias("text")).mapInArrow(lean(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    counts: dict[bytes, int]  # of the head's words, by falling count
    ids: dict[bytes, int]  # of the shortlist's words
    tokens: int
    types: int
    inside: np.ndarray  # of each class: log10 of its tokens and types and one place for unseen words
    noise: np.ndarray  # probabilities of the ids
    share: float  # of the tokens: those of the shortlist's words


def vocabulary(counts: DataFrame, shortlist: int = SHORTLIST, head: int = HEAD) -> Vocabulary:
    """Totals over all words, and at most head of the most frequent words: all above a count taken from a histogram."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = sorted((r["step"], r["k"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect())  # 16 for each power of two at most
    least, held = None, 0
    for s, k in reversed(steps):
        if held + k > head:
            break
        least, held = s, held + k
    rows = counts.filter(step >= least).collect() if least is not None else []  # head rows at most
    rows.sort(key=lambda r: (-r["n"], r["token"]))
    known = {r["token"].encode(): r["n"] for r in rows}
    ends = known.get(b"", 0)
    top = [w for w in known if w][:shortlist]
    ids = {w: k + 1 + CLASSES for k, w in enumerate(top)}
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counts.filter("token <> ''").groupBy(_class_of(F.col("token")).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows at most
        tokens[row["c"]], types[row["c"]] = row["n"], row["v"]
    for word in top:
        c = class_id(word) - 1
        tokens[c], types[c] = tokens[c] - known[word], types[c] - 1
    inside = sum(known[w] for w in top)
    weights = np.concatenate([[ends], tokens, [known[w] for w in top]]) + 1
    return Vocabulary(known, ids, total["n"], total["v"], np.log10(tokens + types + 1), weights / weights.sum(), inside / max(total["n"], 1))


def train(docs: DataFrame, vocab: Vocabulary, rounds=ROUNDS) -> Params:
    """Rounds of local training and averaging; each training document is used in one round."""
    context = docs.sparkSession.sparkContext
    ids, noise = context.broadcast(vocab.ids), vocab.noise
    params = fresh_params(noise)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    source = docs.select("doc_id", text_or_empty().alias("text"))
    begin = 0.0
    for number, (share, rate) in enumerate(rounds):
        last = number == len(rounds) - 1
        part = source.filter((place >= begin) & (F.lit(True) if last else place < begin + share)).select("text")
        begin += share
        start = context.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], rate=rate, start=start, number=number) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            trainer = Trainer(start.value, noise, rate, seed=1000 * number + task % 1000)
            known, held, size, total = ids.value, [], 0, 0

            def learn():
                target, near, _ = _stream(held)
                order = trainer.draw.permutation(len(target))
                for at in range(0, len(order), BATCH):
                    pick = order[at : at + BATCH]
                    trainer.batch(target[pick], [c[pick] for c in near])
                return len(target)

            for batch in batches:
                for text in batch.column(0).cast(pa.binary()).to_pylist():
                    held.append([known.get(w) or class_id(w) for w in tokens_of(text)])
                    size += len(held[-1]) + 1
                    if size >= BUFFER:
                        total += learn()
                        held, size = [], 0
            if held:
                total += learn()
            if total:
                flat = trainer.p.flat()
                blocks = [flat[at : at + BLOCK] for at in range(0, len(flat), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.list_(pa.float32())), pa.array([float(total)] * n)], names=["task", "block", "x", "weight"])

        copies = part.mapInArrow(lean(run), "task int, block int, x array<float>, weight double")
        some = copies.groupBy(F.floor(F.col("task") / FAN_IN).cast("int").alias("task"), "block").applyInPandas(_mean, copies.schema)
        whole = some.groupBy("block").applyInPandas(_mean, copies.schema).orderBy("block").collect()  # one copy of the model
        if whole:
            params = params.like(np.concatenate([np.array(r["x"], np.float32) for r in whole]))
    return params


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.average(np.stack(pdf["x"].to_list()), axis=0, weights=pdf["weight"])
    return pd.DataFrame({"task": pdf["task"].iloc[:1], "block": pdf["block"].iloc[:1], "x": [x.astype(np.float32)], "weight": [pdf["weight"].sum()]})


class Tables(NamedTuple):
    """Log scores of a word after each context word, and the log normaliser of each pair of them."""

    first: np.ndarray
    second: np.ndarray
    log_total: np.ndarray

    @classmethod
    def of(cls, p: Params) -> Tables:
        first = (p.words * p.mix[0]) @ p.outputs.T + p.bias
        second = (p.words * p.mix[1]) @ p.outputs.T
        a, b = first.max(1, keepdims=True), second.max(1, keepdims=True)
        log_total = np.log(np.exp(first - a) @ np.exp(second - b).T) + a + b.T
        return cls(first.astype(np.float32), second.astype(np.float32), log_total.astype(np.float32))

    def log_prob(self, target: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
        near, far = context
        return self.first[near, target] + self.second[far, target] - self.log_total[near, far]


class _Shared(NamedTuple):
    """What scoring tasks share; the key is another one for each model, so that a worker never takes an earlier model's tables."""

    key: str
    vocab: Vocabulary
    params: Params


_TABLES: dict[str, Tables] = {}


def _tables(shared: _Shared) -> Tables:
    """A worker's tables of the broadcast model, made once and kept for its next tasks."""
    if shared.key not in _TABLES:
        _TABLES.clear()
        _TABLES[shared.key] = Tables.of(shared.params)
    return _TABLES[shared.key]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Learns from rows outside the held-out fold. Null texts are empty (one end token); null ids stay, in the fold of
    empty text; repeated rows count, train and score one by one; without training rows, every token is unseen; an
    empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    held_out = doc_hash_mod(FOLDS) == HELD_OUT
    training = docs.filter(~held_out)
    counts = materialize(count_words(training), "word-counts")
    vocab = vocabulary(counts)
    params = train(training, vocab)
    shared = context.broadcast(_Shared(uuid.uuid4().hex, vocab, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, inside = shared.value.vocab, [0.0, *shared.value.vocab.inside.tolist()]
        tables, ids, known = _tables(shared.value), vocab.ids, vocab.counts
        base = math.log10(vocab.tokens + vocab.types + 1)

        def fact(word: bytes, n: int) -> tuple[int, float, float]:
            """id, log10 of the base probability, log10 of the probability within the word's class."""
            if word in ids:
                return ids[word], math.log10(n + 1) - base, 0.0
            return class_id(word), math.log10(n + 1) - base, math.log10(n + 1) - inside[class_id(word)]

        facts = {w: fact(w, n) for w, n in known.items()}
        end_base = math.log10(known.get(b"", 0) + 1) - base
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 256):
                streams, rows = [], []
                for text in texts[at : at + 256]:
                    words = tokens_of(text)
                    found = [facts.get(w) for w in words]
                    tail = Counter(w for w, f in zip(words, found, strict=True) if f is None)
                    # a tail word's count is joined later; what doesn't depend on it is known here
                    missing = {w: (class_id(w), 0.0, -inside[class_id(w)]) for w in tail}
                    found = [f or missing[w] for w, f in zip(words, found, strict=True)] if tail else found
                    streams.append([f[0] for f in found])
                    known_words = len(words) - sum(tail.values()) + (b"" in known)
                    rows.append((uid, len(words) + 1, known_words, end_base + sum(f[1] for f in found), sum(f[2] for f in found), list(tail.keys()), list(tail.values())))
                    uid += 1
                target, near, lengths = _stream(streams)
                log_p = tables.log_prob(target, near).astype(np.float64) / math.log(10)
                sums = np.add.reduceat(log_p, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                u, n, k, b, i, words, times = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(u, pa.int64()), batch.column(0).slice(at, 256), batch.column(1).slice(at, 256), pa.array(n, pa.int64()), pa.array(k, pa.int64()),
                        pa.array(b, pa.float64()), pa.array(sums + np.array(i), pa.float64()),
                        pa.array(words, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "n_head", "base", "model", "words", "times"],
                )

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, model double, words array<string>, times array<long>"
    rows = materialize(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_or_empty().alias("text")).mapInArrow(lean(run), schema), "scored")
    tail = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("t")).select("uid", F.col("t.words").alias("token"), F.col("t.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    base = math.log10(vocab.tokens + vocab.types + 1)
    log_n = F.log10((n + 1).cast("double"))
    rest = tail.join(counts, "token", "left").groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_tail"), F.sum(F.col("times") * (log_n - base)).alias("tail_base"), F.sum(F.col("times") * log_n).alias("tail_model"),
    )
    zero = F.lit(0.0)
    return rows.drop("words", "times").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("model") + F.coalesce("tail_model", zero)).alias("score"),
    )
