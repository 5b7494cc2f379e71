"""Benchmark decontamination by templates: DataFrame operations only.

Numbers, units and names become typed placeholders that carry their value; windows of template words are hashed and
joined with the benchmark's, and a match must map each of the item's slot values to one value of the document, so that
re-parameterised questions are caught and mere likeness of form is not. The benchmark's windows are broadcast only if
their counted size allows, else both sides are shuffled by window hash. Matches, not documents, are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_LIMIT_BYTES, materialize, quoted, small_enough

WORDS = 8
#: An item is found if half its windows, or this many, are.
ENOUGH_WINDOWS = 8
SHARE = 0.5
#: Ways to look an item up (_item_windows).
TEMPLATE, LITERAL, WHOLE = "template", "literal", "whole"

#: Marks of a slot: what stands before a placeholder's type, and between the type and its value.
SLOT, VALUE = "\ue000", "\ue001"
# Units of measure that follow a number.
UNITS = "kilometers?|kilometres?|km|meters?|metres?|miles?|feet|inches|cm|mm|kg|kilograms?|grams?|pounds?|lbs?|liters?|litres?|ml|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|percent|%|dollars?|euros?|usd|eur|degrees?|mph|kmh|gb|mb"
_NUMBER = r"\d+(?:[.,:/]\d+)*"


def template_words(text: Column) -> Column:
    """Lower-cased words without punctuation; a slot is one word: mark, type, mark, value."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains(SLOT) | t.contains(VALUE), F.translate(t, SLOT + VALUE, "")).otherwise(t)
    # a name: capitalised words after a word that doesn't end a sentence
    t = F.regexp_replace(t, r"(?<=[\p{L}\d,;:]\s)\p{Lu}[\p{L}\p{M}'’-]*", f" {SLOT}name{VALUE}$0")
    n = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\d.,])[$€£]?({_NUMBER})\s?({UNITS})(?![\p{{L}}\d])", f" {SLOT}num{VALUE}$1 {SLOT}unit{VALUE}$2 ")
    n = F.regexp_replace(n, rf"(?<![\p{{L}}\d.,{VALUE}])[$€£]?{_NUMBER}(?![\p{{L}}\d])", f" {SLOT}num{VALUE}$0 ")
    t = F.when(t.rlike(r"\d"), n).otherwise(t)
    t = F.lower(F.regexp_replace(t, r"[.,;:!?\"()\[\]{}<>«»“”]+", ""))
    return F.split(F.btrim(t, F.lit(" \t\n\r\x0b\x0c")), r"\s+")


def _held(column: Column) -> Column:
    """A generated column: the optimizer doesn't write its expression again into each use (as in lambdas)."""
    return F.explode(F.array(column))


def _value(word: Column) -> Column:
    """A template word as it stands in the text, whether it is a slot or not."""
    return F.substring_index(word, VALUE, -1)


def _windows(words: DataFrame, n: int, literal: bool = False) -> DataFrame:
    """Adds windows, the hashes of each n consecutive template words (literal: of the words themselves), to a table with words."""
    held = words.withColumn("kinds", _held(F.transform("words", lambda x: F.xxhash64(_value(x) if literal else F.substring_index(x, VALUE, 1)))))
    full = F.size("kinds") >= n
    starts = F.when(full, F.sequence(F.lit(0), F.size("kinds") - n)).otherwise(F.array().cast("array<int>"))
    return held.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(*[F.get("kinds", i + k) for k in range(n)]))).drop("kinds")


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """(n, way, h, item_id, j, n_windows, slotted) of items with n words or more, or, where n is less than WORDS, exactly n.

    Windows with more slots than words are left out (way TEMPLATE), as any list of numbers has them. Items that have no
    other windows are looked up by all windows of their own values (LITERAL), and by the template windows that hold a word
    besides slots (WHOLE), which count only where the whole item's template stands.
    """
    words = items.select("item_id", _held(template_words(F.col("text"))).alias("words"))
    words = words.filter(F.size("words") >= n) if n == WORDS else words.filter(F.size("words") == n)

    def listed(way: str) -> DataFrame:
        out = _windows(words, n, way == LITERAL).select("item_id", "words", F.posexplode("windows").alias("j", "h"))
        slots = F.size(F.filter(F.slice("words", F.col("j") + 1, n), lambda x: x.startswith(SLOT)))
        return out.select("item_id", "j", "h", slots.alias("slots"))

    def counted(out: DataFrame, way: str) -> DataFrame:
        slotted = F.lit(False) if way == LITERAL else F.max(F.col("slots") > 0)
        first = out.groupBy("item_id", "h").agg(F.min("j").alias("j"), slotted.alias("slotted"))
        sizes = first.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
        return first.join(sizes, "item_id").select(F.lit(n).alias("n"), F.lit(way).alias("way"), "h", "item_id", "j", "n_windows", "slotted")

    few = 2 * F.col("slots") <= n
    template = listed(TEMPLATE)
    heavy = template.groupBy("item_id").agg(F.max(few).alias("any")).filter(~F.col("any")).select("item_id")
    out = counted(template.filter(few), TEMPLATE)
    out = out.union(counted(listed(LITERAL).join(heavy, "item_id", "left_semi"), LITERAL))
    return out.union(counted(template.filter(F.col("slots") < n).join(heavy, "item_id", "left_semi"), WHOLE))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, kind, text_hash) of each document that holds a benchmark item.

    n_found of an item's n_windows distinct template windows of eight words stand in the document, in alignments whose
    slots are consistent: half of the windows, or eight. kind is verbatim if all slot values are the item's own, else
    reparameterised. Shorter items are looked up whole. Windows with more slots than words aren't looked up, unless an item
    has no others: then half of its windows (or eight) count as they are written, and its whole template with other
    values; an item of slots alone has no template to know it by, and is found as written only.

    Null texts are empty and match nothing; null ids stay; rows of equal id and text give one row an item; text_hash
    (xxhash64 of the text) tells documents of one id apart. Empty tables give no rows; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select("item_id", "text").filter(F.col("text").rlike(r"\S"))
    sized = items.select(F.least(F.size(template_words(F.col("text"))), F.lit(WORDS)).alias("n")).filter("n > 0").distinct()
    lengths = sorted(r["n"] for r in sized.collect())  # at most WORDS values
    if not lengths:
        lengths = [WORDS]
    wanted = None
    for n in lengths:
        part = _item_windows(items, n)
        wanted = part if wanted is None else wanted.union(part)
    wanted = materialize(wanted, "item-windows")
    broadcast = small_enough(wanted, row_bytes=200)
    literal = {r["n"] for r in wanted.filter(F.col("way") == LITERAL).select("n").distinct().collect()}  # at most WORDS values
    words = docs.select("doc_id", "text_hash", _held(template_words(F.col("text"))).alias("words"))
    found = None
    for n, as_written in [(n, False) for n in lengths] + [(n, True) for n in lengths if n in literal]:
        hashed = _windows(words, n, as_written).select("doc_id", "text_hash", F.posexplode("windows").alias("i", "h"))
        ours = wanted.filter((F.col("n") == n) & ((F.col("way") == LITERAL) == F.lit(as_written))).drop("n")
        part = hashed.join(F.broadcast(ours) if broadcast else ours, "h").withColumn("n", F.lit(n))
        found = part if found is None else found.union(part)
    by = ["doc_id", "text_hash", "item_id"]
    pairs = found.groupBy(*by, "way").agg(
        F.max("n").alias("n"), F.max("n_windows").alias("n_windows"), F.max("slotted").alias("slotted"), F.collect_set(F.struct("i", "j")).alias("at"),
    )
    pairs = materialize(pairs.withColumn("n_found", F.size(F.array_distinct(F.transform("at", lambda x: x["j"])))).filter(_enough("n_found")), "leaks")
    plain = pairs.filter(~F.col("slotted")).select(*by, "n_windows", "n_found", F.lit("verbatim").alias("kind"))
    out = plain.unionByName(_consistent(pairs.filter("slotted"), docs, items))
    if literal:
        # an item looked up in two ways is one row; verbatim comes first
        best = F.max(F.struct((F.col("kind") == "verbatim").alias("first"), "n_windows", "n_found", "kind")).alias("best")
        out = out.groupBy(*by).agg(best).select(*by, "best.n_windows", "best.n_found", "best.kind")
    return out.select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("n_found").cast("long"), "kind", "text_hash")


def _enough(found: str) -> Column:
    return F.col(found) >= F.least(F.ceil(F.col("n_windows") * SHARE), F.lit(ENOUGH_WINDOWS))


def _consistent(pairs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs whose slots hold: for each alignment, an item's value of a slot type stands for one value of the document.

    Of other alignments only the windows without slots count.
    """
    by = ["doc_id", "text_hash", "item_id"]
    # a pair's rows carry no text; only documents with a slotted pair are read again
    few = pairs.select("doc_id", "text_hash", "item_id", "way", "n", "n_windows", "at")
    # a pair lists all its matching windows, so its bytes are counted, not its rows
    weight = few.agg(F.sum(100 + 16 * F.size("at").cast("long"))).first()[0] or 0
    few = F.broadcast(few) if weight <= BROADCAST_LIMIT_BYTES else few
    same = F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p.text_hash") == F.col("d.text_hash"))
    held = few.alias("p").join(docs.alias("d"), same).select("p.doc_id", "p.text_hash", "p.item_id", "p.way", "p.n", "p.n_windows", "p.at", _held(template_words(F.col("d.text"))).alias("doc_words"))
    item_words = items.select("item_id", _held(template_words(F.col("text"))).alias("item_words"))
    both = held.join(item_words, "item_id").select(*by, "way", "n", "n_windows", "doc_words", "item_words", F.explode("at").alias("m"))
    shift = (F.col("m.i") - F.col("m.j")).alias("shift")
    whole = F.col("way") == WHOLE
    start, size = F.when(whole, 0).otherwise(F.col("m.j")), F.when(whole, F.size("item_words")).otherwise(F.col("n"))
    # a whole item stands where each word is of the same kind (or, as a name's first letter depends on its place, is the same)
    same_word = lambda x, y: (F.substring_index(x, VALUE, 1) == F.substring_index(y, VALUE, 1)) | (_value(x) == _value(y))
    stands = F.forall(F.zip_with("item_words", F.slice("doc_words", F.greatest(shift, F.lit(0)) + 1, F.size("item_words")), same_word), lambda x: F.coalesce(x, F.lit(False)))
    both = both.filter(~whole | ((shift >= 0) & stands))
    slots = F.filter(
        F.arrays_zip(F.slice("item_words", start + 1, size).alias("mine"), F.slice("doc_words", start + shift + 1, size).alias("theirs")),
        lambda x: x["mine"].startswith(SLOT),
    )
    rows = both.select(*by, "n_windows", shift, F.col("m.j").alias("j"), F.explode_outer(slots).alias("slot"))
    values = rows.groupBy(*by, "n_windows", "shift", "slot.mine").agg(F.collect_set("slot.theirs").alias("values"), F.collect_set("j").alias("js"))
    aligned = values.groupBy(*by, "n_windows", "shift").agg(
        F.max(F.size("values")).alias("most"), F.max((F.size("values") > 0) & ~F.array_contains("values", F.coalesce("mine", F.lit("")))).alias("changed"),
        F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.flatten(F.collect_list(F.when(F.col("mine").isNull(), F.col("js")))).alias("free"),
    )
    # where slots don't hold, the alignment's windows without slots still do
    held = F.col("most") <= 1
    aligned = aligned.select(*by, "n_windows", F.when(held, F.col("js")).otherwise(F.col("free")).alias("js"), (F.col("changed") | ~held).alias("changed"))
    whole = aligned.filter(F.size("js") > 0).groupBy(*by, "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("n_found"), F.max("changed").alias("changed"))
    return whole.filter(_enough("n_found")).select(*by, "n_windows", "n_found", F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; all its columns stay as they are."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    bad = materialize(bad, "leaky")
    few = F.broadcast(bad) if small_enough(bad, row_bytes=64) else bad
    text_hash = F.xxhash64(F.coalesce(F.col(quoted("text")), F.lit("")))
    return docs.join(few, docs["doc_id"].eqNullSafe(few["leak_id"]) & (text_hash == few["leak_hash"]), "left_anti")
