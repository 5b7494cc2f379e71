"""Exact Jaccard join of documents on five-word shingles, by partition of the shingle universe and the pigeonhole rule.

Equal sets become one class first. Shingles that only one class has can't be shared: a class of which more than a quarter
stands alone links with nothing and goes no further. The rest are dealt into segments of the universe, separately for
each band of set sizes; two linked sets differ in few enough shingles that some segment agrees wholly, or but for one
shingle where the band's allocation gives segments one-deletion neighbourhoods. Which of the two a band uses, and how
many segments it has in reserve so that sets can leave out their emptiest ones, is chosen by cost from the band's counts.

Sets with a common signature are measured against the bucket's first set, which is linear in the bucket. Sets near one
pivot are a cluster; what the pivots left unlinked there is compared with the whole cluster in blocks, as products of
matrices; sets far from all of a bucket's pivots are compared pair by pair if few, else in blocks as well. So each candidate pair is verified exactly
or lies in one component already, and no group's pairs are ever listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WIDE_ROWS, by_part, dealt, discard, lean, materialize, parts_for, short_batches, small_enough, text_or_empty
from quarry.llm.graph import components

WORDS = 5
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of SAMPLE_OF parts of the shingle universe, those that are counted to find shingles of one class; more than a quarter.
SAMPLE, SAMPLE_OF = 3, 8
CACHE_WORDS = 200_000
BATCH_DOCS = 2000
#: Bytes of shingles and counts that a task holds of one part of the universe.
PART_BYTES = 16 << 20
#: Rows written that cost as much as measuring a pair.
PAIR_ROWS = 20
#: Shingles whose frequency signatures are told: those in so many sets, or in more, so that there are at most MOST_FREQUENT.
FREQUENT, MOST_FREQUENT = 20, 500_000
#: Rounds in which each bucket's sets are measured against one of them, before all pairs of those still far from all.
PIVOT_ROUNDS = 2
#: Jaccard similarity to a pivot at which a set leaves its bucket's list, and at which it is in the pivot's cluster.
CLOSE, NEAR = 0.55, 0.3
#: Sets of a block's side, and shingles of a block's product at once.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 4096
#: Sets of a bucket that are close to no pivot and yet compared pair by pair: so many at most, or else in blocks.
FEW = 16

U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


class Shingler:
    """64-bit hashes of the distinct shingles of a text; word hashes are cached up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted hashes: of each five words, or of all words where there are fewer; none without words."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, U64)
        known = self.known
        try:
            h = np.array([known[w] for w in words], U64)
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], U64)
        n = max(len(h) - WORDS + 1, 1)
        total = np.full(n, min(len(h), WORDS), U64)
        for k in range(min(len(h), WORDS)):
            total = _mix(total + h[k : k + n])
        return np.unique(total)


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, d1, d2, sample of each row: the set's size, a 128-bit digest of it, and six bytes of each
    shingle in the sampled part of the universe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            n, d1, d2, sample = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingler.shingles(text)
                digest = xxhash.xxh128_intdigest(s.tobytes(), seed=len(s))
                n.append(len(s)), d1.append(_signed(digest >> 64)), d2.append(_signed(digest & (1 << 64) - 1))
                sample.append(_packed(s[s % U64(SAMPLE_OF) < U64(SAMPLE)] >> U64(16)))
            columns = [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(sample, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "d1", "d2", "sample"])

    return _texts(docs).mapInArrow(lean(run), "doc_id long, text_hash long, n long, d1 long, d2 long, sample binary")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**48 in six bytes each."""
    return np.ascontiguousarray(numbers, U64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _six(blob: bytes, n: int | None = None, at: int = 0) -> np.ndarray:
    """Numbers of six bytes each: n of them from a place on, or all."""
    n = len(blob) // 6 if n is None else n
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    return out.view("<u8").reshape(-1)


def _begins(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal values begins and ends."""
    if not len(part):
        return np.zeros(0, int), np.zeros(0, int)
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return begins, np.append(begins[1:], len(part))


def _blobs(part: np.ndarray, parts: int, *columns: tuple[np.ndarray, bool]) -> pa.RecordBatch:
    """(part, blob): columns of numbers by part, one blob for each; a column is told by its values and whether six bytes do."""
    part = (part % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    ordered = [(values[order], short) for values, short in columns]
    begins, ends = _begins(part)
    blobs = [b"".join(_packed(v[a:b]) if short else v[a:b].tobytes() for v, short in ordered) for a, b in zip(begins, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[begins], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _class_number(d1: Column) -> Column:
    """Six bytes of a class's digest."""
    return F.shiftrightunsigned(d1, 16)


def _lone_shingles(profiles: DataFrame, total: int) -> DataFrame:
    """(number, lone): how many shingles of the sampled universe only the class of that number has, or fewer; total is how
    many shingles all rows have. Many tasks combine their own first.

    Six bytes of a shingle will do: shingles taken for one another only make fewer lone ones.
    """
    parts = parts_for(12 * total * SAMPLE // SAMPLE_OF, PART_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, numbers = [], []

        def flush():
            sizes = [len(t) // 6 for t in tokens]
            token, low, high = _extremes(_six(b"".join(tokens)), np.repeat(np.array(numbers, U64), sizes))
            twice = low != high
            token, number = np.concatenate([token, token[twice]]), np.concatenate([low, high[twice]])
            return _blobs(token >> U64(20), parts, (token, True), (number, True))

        for batch in batches:
            tokens += batch.column(1).to_pylist()
            numbers += batch.column(0).to_pylist()
            if len(tokens) >= BATCH_DOCS:
                yield flush()
                tokens.clear(), numbers.clear()
        if tokens:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(batches):
            tokens, numbers = [], []
            for row in rows:
                n = len(row["blob"]) // 12
                tokens.append(_six(row["blob"], n)), numbers.append(_six(row["blob"], n, 6 * n))
            _, low, high = _extremes(np.concatenate(tokens), np.concatenate(numbers))
            number, lone = np.unique(low[low == high], return_counts=True)
            yield _blobs(number, parts, (number, True), (np.minimum(lone, 65_535).astype("<u2"), False))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(batches):
            numbers, counts = [], []
            for row in rows:
                n = len(row["blob"]) // 8
                numbers.append(_six(row["blob"], n)), counts.append(np.frombuffer(row["blob"], "<u2", n, 6 * n))
            number, at = np.unique(np.concatenate(numbers), return_inverse=True)
            lone = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            for at in range(0, len(number), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(number[at : at + 50_000].view(np.int64)), pa.array(lone[at : at + 50_000])], names=["number", "lone"])

    shingles = dealt(profiles.filter("n > 0").select(_class_number(F.col("d1")), "sample").mapInArrow(lean(deal), "part int, blob binary"), parts)
    counted = dealt(shingles.mapInArrow(lean(count), "part int, blob binary"), parts)
    return counted.mapInArrow(lean(add), "number long, lone long")


def _extremes(token: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens with the least and greatest number of each."""
    if not len(token):
        return token, number, number
    order = np.argsort(token, kind="stable")
    token, number = token[order], number[order]
    begins, _ = _begins(token)
    return token[begins], np.minimum.reduceat(number, begins), np.maximum.reduceat(number, begins)


class Plan(NamedTuple):
    """How a band's universe is cut: segments that must agree wholly, and ones that may differ by a shingle."""

    whole: int
    loose: int

    @property
    def worth(self) -> int:
        return self.whole + 2 * self.loose


def band_starts(largest: int) -> list[int]:
    """Least sizes of the bands: sets of linked sizes lie in one band or in two neighbours."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // PERCENT)))
    return starts


def _beyond(mean: float, spare: int) -> float:
    """How much a Poisson number of this mean exceeds spare, on average."""
    if mean <= 0:
        return 0.0
    term, total = math.exp(-min(mean, 700)), 0.0
    for x in range(int(mean + 12 * math.sqrt(mean) + spare + 12)):
        total += max(x - spare, 0) * term
        term *= mean / (x + 1)
    return total


def allocate(size: int, sets: int) -> Plan:
    """The cheapest plan for sets of up to this size when so many of them meet: rows written, and pairs of unlike sets
    that agree because both have nothing (or, where a shingle may differ, one at most) in a segment that neither could
    leave out."""
    # linked sets of sizes a and b differ in at most (a + b) * (100 - PERCENT) / (100 + PERCENT) shingles
    need = 1 + 2 * size * (100 - PERCENT) // (100 + PERCENT)
    best, least = Plan(need, 0), math.inf
    for reserve in (0.0, 0.15, 0.35, 0.7, 1.2):
        worth = need + math.ceil(reserve * need)
        for loose in {0, worth // 4, worth // 2}:
            plan = Plan(worth - 2 * loose, loose)
            segments = plan.whole + plan.loose
            mean = size / segments
            spare = math.floor((worth - 1) / 2 - size * (100 - PERCENT) / (100 + PERCENT))
            none = (1 - 1 / segments) ** size
            one = size / segments * (1 - 1 / segments) ** (size - 1)
            # segments kept although they tell nothing
            weak = plan.whole * none + plan.loose * (none + one)
            kept = _beyond(weak, max(spare, 0) * segments // worth) / segments
            rows = sets * (segments - max(spare, 0) * segments / worth + loose * mean)
            cost = rows + PAIR_ROWS / 2 * sets * sets * segments * kept * kept
            if cost < least:
                best, least = plan, cost
    return best


class Frequent(NamedTuple):
    """Frequent shingles in order, and in how many sets each is."""

    tokens: np.ndarray
    sets: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """How many sets hold each token; 1 for those that aren't frequent."""
        if not len(self.tokens):
            return np.ones(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.sets[at], 1)


def signatures(tokens: np.ndarray, band: int, plan: Plan, frequent: Frequent) -> np.ndarray:
    """The keys of one set in one band's plan. A set leaves out segments worth its share of the reserve: empty ones, then
    those that most other sets can have, which is at most as many as have the rarest of a segment's shingles."""
    segments = plan.whole + plan.loose
    spare = math.floor((plan.worth - 1) / 2 - len(tokens) * (100 - PERCENT) / (100 + PERCENT))
    hashed = _mix(tokens ^ U64(band * 0x51_7C_C1_B7))
    segment = (hashed % U64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, hashed = segment[order], _mix(hashed[order] + U64(1))
    count = np.bincount(segment, minlength=segments)
    begins = np.concatenate([[0], np.cumsum(count)[:-1]])
    running = np.concatenate([[U64(0)], np.cumsum(hashed, dtype=U64)])
    sums = running[begins + count] - running[begins]
    sharers = np.full(segments, np.iinfo(np.int64).max)
    np.minimum.at(sharers, segment, frequent.of(tokens[order]))
    worth = np.where(np.arange(segments) < plan.whole, 1, 2)
    by_cost = np.lexsort((count, -sharers))
    left_out = by_cost[np.cumsum(worth[by_cost]) <= spare]
    kept = np.ones(segments, bool)
    kept[left_out] = False
    mark = _mix(np.arange(segments, dtype=U64) + U64(band << 32))
    keys = [_mix(sums[kept] + mark[kept])]
    loose = kept & (worth == 2)
    of_loose = loose[segment]
    keys.append(_mix(sums[segment[of_loose]] - hashed[of_loose] + mark[segment[of_loose]]))
    return np.unique(np.concatenate(keys))


def _frequent(sets: DataFrame) -> Frequent:
    """Shingles in many sets: as few as the least frequency implies, whatever the table's size."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(FREQUENT, -(-total // MOST_FREQUENT))
    parts = parts_for(10 * total, PART_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return _blobs(token >> U64(20), parts, (token, True), (n.astype("<u4"), False))

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(_six(blob))
                size += len(held[-1])
                if size >= 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(batches):
            tokens, counts = [], []
            for row in rows:
                n = len(row["blob"]) // 10
                tokens.append(_six(row["blob"], n)), counts.append(np.frombuffer(row["blob"], "<u4", n, 6 * n))
            token, n = np.concatenate(tokens), np.concatenate(counts).astype(np.int64)
            order = np.argsort(token, kind="stable")
            token, n = token[order], n[order]
            begins, _ = _begins(token)
            token, n = token[begins], np.add.reduceat(n, begins)
            many = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many])], names=["token", "n"])

    counted = dealt(sets.select("tokens").mapInArrow(lean(deal), "part int, blob binary"), parts).mapInArrow(lean(count), "token long, n long")
    counted = materialize(counted, "frequent")
    rows = counted.toPandas()  # total / least rows at most
    discard(counted)
    tokens = rows["token"].to_numpy(np.int64).view(U64)
    order = np.argsort(tokens)
    return Frequent(tokens[order], rows["n"].to_numpy(np.int64)[order])


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n, tokens) of each class, from the text of its representative row; tokens are six bytes of each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            tokens = [np.unique(shingler.shingles(t) >> U64(16)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array([_packed(t) for t in tokens], pa.binary())], names=["cid", "n", "tokens"])

    few = classes.select("cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    few = F.broadcast(few) if small_enough(few, row_bytes=64) else few
    texts = _texts(docs)
    found = texts.join(few, texts["doc_id"].eqNullSafe(few["rep_id"]) & (texts["text_hash"] == few["rep_hash"]))
    return found.select("cid", "text").mapInArrow(lean(run), "cid long, n long, tokens binary")


def _keys(sets: DataFrame, starts: list[int], plans: dict[int, Plan], frequent: Frequent) -> DataFrame:
    """(key, cid): signatures of each set in its own band, and in the next one if linked sets can lie there."""
    common = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cids = [], []
            for cid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _six(blob)
                band = int(np.searchsorted(starts, len(tokens), side="right")) - 1
                for b in (band, band + 1):
                    if b in plans and (b == band or len(tokens) * 100 // PERCENT >= starts[b]):
                        keys.append(signatures(tokens, b, plans[b], common.value))
                        cids.append(np.full(len(keys[-1]), cid, np.int64))
            if keys:
                key, cid = np.concatenate(keys).view(np.int64), np.concatenate(cids)
                for at in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), pa.array(cid[at : at + 100_000])], names=["key", "cid"])

    return sets.select("cid", "tokens").mapInArrow(lean(run), "key long, cid long")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) of pairs (a, b), a table in the shared folder: exact sizes of the intersection and the union of
    their sets. The set of b travels to that of a; pairs go to the sets of b where their counted size allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x is not last and x != last:
                    last, of_last = x, _six(x)
                both = np.concatenate([of_last, _six(y)])
                both.sort()
                common.append(int((both[1:] == both[:-1]).sum()))
                total.append(len(both) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    of_a = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("tokens_a"))
    of_b = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tokens_b"))
    few = F.broadcast(pairs) if small_enough(pairs, row_bytes=48) else pairs
    met = of_b.join(few, "b").join(of_a, "a").select("a", "b", "tokens_a", "tokens_b")
    return materialize(met.mapInArrow(lean(run), "a long, b long, common long, total long"), "measured", WIDE_ROWS)


def _is_link() -> Column:
    return 100 * F.col("common") >= PERCENT * F.col("total")


def _met(keys: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measured pairs of sets with a common key, (a, b, common, total), in two tables: of each bucket's sets with its
    pivots, and of all pairs of sets that were close to no pivot of their bucket, where it has few. Where it has many, they are
    returned as edges (a, b) to the first of them, to be compared as a cluster.

    A set leaves a bucket's list once it is CLOSE to a pivot. A set that links with it is then at least NEAR that pivot
    (Jaccard distance obeys the triangle inequality, and a link is at most 1/4 long), so both are in one cluster.
    """
    open_, known, before = keys, None, keys
    for _ in range(PIVOT_ROUNDS):
        # the least number is the set with the smallest share of lone shingles: what copies were made of
        pivots = open_.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("last")).filter("a < last").drop("last")
        met = materialize(open_.join(pivots, "key").filter("cid != a").withColumnRenamed("cid", "b"), "met")
        discard(before)
        before = met
        pairs = met.select("a", "b").distinct()
        pairs = materialize(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), "pairs")
        measured = _measured(pairs, sets)
        discard(pairs)
        known = measured if known is None else known.union(measured)
        close = known.filter(F.col("common") >= CLOSE * F.col("total")).select("a", "b")
        open_ = met.join(close, ["a", "b"], "left_anti").select("key", F.col("b").alias("cid"))
    counted = open_.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("first")).filter("k > 1")
    open_ = materialize(open_.join(counted, "key"), "far")
    discard(before)
    crowd = materialize(open_.filter(F.col("k") > FEW).filter("cid != first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), "crowd")
    few = open_.filter(F.col("k") <= FEW).select("key", "cid")
    left, right = few.withColumnRenamed("cid", "a"), few.withColumnRenamed("cid", "b")
    sizes = sets.select("cid", "n")
    pairs = left.join(right, "key").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(known, ["a", "b"], "left_anti")
    pairs = pairs.join(sizes.select(F.col("cid").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("cid").alias("b"), F.col("n").alias("n_b")), "b")
    pairs = materialize(pairs.filter((F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * PERCENT)).select("a", "b"), "pairs")
    far = _measured(pairs, sets)
    discard(pairs, open_)
    return known, far, crowd


def _block_links(rows: list[tuple[int, int, bytes]], columns: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """Links between sets of different components, as a forest: of rows (cid, component, tokens) with columns, from one
    product of matrices over the shingles that both sides have."""
    of = [_six(t) for _, _, t in rows], [_six(t) for _, _, t in columns]
    both = np.intersect1d(np.unique(np.concatenate(of[0])), np.unique(np.concatenate(of[1])), assume_unique=True)
    common = np.zeros((len(rows), len(columns)), np.float32)

    def places(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, token = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side)
        at = np.searchsorted(both, token)
        found = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == token) if len(both) else np.zeros(len(token), bool)
        return owner[found], at[found]

    (r_owner, r_at), (c_owner, c_at) = places(of[0]), places(of[1])
    for begin in range(0, len(both), BLOCK_SHINGLES):
        width = min(BLOCK_SHINGLES, len(both) - begin)
        sides = []
        for owner, at, count in ((r_owner, r_at, len(rows)), (c_owner, c_at, len(columns))):
            pick = (at >= begin) & (at < begin + width)
            side = np.zeros((count, width), np.float32)
            side[owner[pick], at[pick] - begin] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    total = np.array([len(x) for x in of[0]])[:, None] + np.array([len(x) for x in of[1]])[None, :] - common
    apart = np.array([c for _, c, _ in rows])[:, None] != np.array([c for _, c, _ in columns])[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, j in np.argwhere(apart & (100 * common >= PERCENT * total)).tolist():
        a, b = root(rows[i][1]), root(columns[j][1])
        if a != b:
            parent[a] = b
            links.append((rows[i][0], columns[j][0]))
    return links


def _within_clusters(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components of a cluster, from members (cid, cluster, component). All but the cluster's
    largest component are compared with everything in it, in blocks of bounded size that any number of tasks can share."""
    parts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("components"), F.sum("k").alias("size"))
    mixed = largest.filter("components > 1").select("cluster", F.col("top.component").alias("main"), F.col("size").alias("size"), (F.col("size") - F.col("top.k")).alias("minor"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK_SETS)).cast("int")
    few = F.broadcast(mixed) if small_enough(mixed, row_bytes=64) else mixed
    placed = members.join(few, "cluster").join(sets.select("cid", "tokens"), "cid")
    spot = lambda n: F.pmod(F.xxhash64("cid"), blocks(n)).cast("int")
    ever = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    column = placed.select("cluster", ever("minor").alias("i"), spot("size").alias("j"), F.lit(1).alias("side"), "cid", "component", "tokens")
    row = placed.filter("component != main").select("cluster", spot("minor").alias("i"), ever("size").alias("j"), F.lit(0).alias("side"), "cid", "component", "tokens")
    dealt = row.unionByName(column).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, found = None, ([], []), []

        def settle():
            if sides[0] and sides[1]:
                found.extend(_block_links(*sides))

        for batch in batches:
            for cluster, i, j, side, *entry in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (cluster, i, j) != now:
                    settle()
                    now, sides = (cluster, i, j), ([], [])
                sides[side].append(tuple(entry))
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def _links(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the sets with links."""
    known, far, crowd = _met(keys, sets)
    links = materialize(known.union(far).filter(_is_link()).select("a", "b"), "links")
    linked = components(links)
    near = known.filter(F.col("common") >= NEAR * F.col("total")).select("a", "b")
    # a set may be in a cluster of either kind; their numbers differ in the last bit
    found = [components(edges) for edges in (near, crowd)]
    clusters = [c.select("node", (2 * F.col("component") + kind).alias("cluster")) for kind, c in enumerate(found)]
    members = clusters[0].union(clusters[1]).join(linked, "node", "left")
    members = materialize(members.select(F.col("node").alias("cid"), "cluster", F.coalesce("component", "node").alias("component")), "members")
    discard(*found, far, crowd)
    more = materialize(_within_clusters(members, sets), "more-links", WIDE_ROWS)
    discard(members)
    if more.isEmpty():
        return linked
    discard(linked)
    return components(links.union(more))


def _numbered(alive: DataFrame) -> DataFrame:
    """alive, a table with the numbers of its rows as they were written (number) and a share in thousandths, with cid: the
    share, then a dense number."""
    task = F.shiftright("number", 33)
    sizes = alive.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    offsets = sizes.select("task", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    joined = alive.join(F.broadcast(offsets), task == F.col("task"))
    place = F.col("offset") + F.col("number").bitwiseAND((1 << 33) - 1)
    return joined.select("d1", "d2", "n", "least_id", "rep", (F.shiftleft("share", 50) + place).alias("cid"))


def _linked(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What link returns, and the tables in the shared folder that it reads."""
    short_batches(docs.sparkSession)
    wide = materialize(_profiles(docs), "profiles")
    profiles = materialize(wide.drop("sample"), "facts")
    classes = profiles.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    classes = materialize(classes, "classes")
    total = profiles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lone = _lone_shingles(wide, total)
    # a number that two classes share counts nothing as lone
    number = _class_number(F.col("d1")).alias("of")
    shared = classes.groupBy(number).agg(F.count(F.lit(1)).alias("sharers"), F.max(F.struct("d1", "d2", "n", "least_id", "rep")).alias("c"))
    single = shared.filter("sharers = 1").select("of", "c.*").join(lone, F.col("of") == F.col("number"), "left").select("d1", "d2", "n", "least_id", "rep", F.coalesce("lone", F.lit(0)).alias("lone"))
    several = classes.withColumn("of", number).join(shared.filter("sharers > 1").select("of"), "of", "left_semi").select("d1", "d2", "n", "least_id", "rep", F.lit(0).cast("long").alias("lone"))
    alive = single.union(several).filter(100 * (F.col("n") - F.col("lone")) >= PERCENT * F.col("n"))
    share = (F.col("lone") * 1000 / F.col("n")).cast("long")
    written = materialize(alive.select("d1", "d2", "n", "least_id", "rep", share.alias("share"), F.monotonically_increasing_id().alias("number")), "alive")
    discard(wide)
    alive = materialize(_numbered(written), "numbered")
    discard(written)
    sets = materialize(_sets(docs, alive).dropDuplicates(["cid"]), "sets")
    largest = sets.agg(F.max("n")).first()[0]
    result = None
    if largest:
        starts = band_starts(largest)
        band = F.lit(0)
        for k, s in enumerate(starts):
            band = F.when(F.col("n") >= s, k).otherwise(band)
        sizes = {r["band"]: r["count"] for r in sets.groupBy(band.alias("band")).count().collect()}  # as many as bands: the log of the largest size
        plans = {b: allocate(starts[b + 1] - 1 if b + 1 < len(starts) else starts[b], sizes.get(b, 0) + sizes.get(b - 1, 0)) for b in sizes}
        keys = materialize(_keys(sets, starts, plans, _frequent(sets)), "keys", WIDE_ROWS)
        result = _links(keys, sets)
    discard(sets)
    if result is not None:
        of_class = alive.join(result.withColumnRenamed("node", "cid"), "cid")
        names = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
        linked = of_class.join(names, "component").select("d1", "d2", "component_id")
        known = classes.join(linked, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component_id", "least_id").alias("component_id"))
    else:
        known = classes.select("d1", "d2", F.col("least_id").alias("component_id"))
    out = profiles.join(known, ["d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash")
    return out, [profiles, classes, alive, *([] if result is None else [result])]


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash of every row of docs (doc_id, text).

    A set is the distinct shingles of five words (all words as one if there are fewer). Documents link when 100 *
    intersection >= 75 * union; component_id is the least doc_id reachable. Null and blank texts have no set and are
    linked with nothing: their component is their own id. Rows of null id take part, and don't name a component unless
    it has no other id (then it is null). Repeated rows are alike; an empty table gives no rows; other columns aren't
    read. Shingles are told apart by 64-bit hashes within a text, and by 48 bits of them across two texts.
    """
    return _linked(docs)[0]


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one of least id; all columns stay as they are.

    Rows that repeat an id are one document, so they stay or go together; components of null ids alone stay.
    """
    found, tables = _linked(docs)
    gone = found.filter(F.col("doc_id").isNull() & F.col("component_id").isNotNull() | (F.col("doc_id") != F.col("component_id")))
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    discard(*tables)
    few = F.broadcast(gone) if small_enough(gone, row_bytes=64) else gone
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(few, docs["doc_id"].cast("long").eqNullSafe(few["gone_id"]) & (text_hash == few["gone_hash"]), "left_anti")
