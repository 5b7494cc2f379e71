"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control: DataFrame operations only.

One pass over the texts keeps patterns' spans and long tokens; what follows works on those few. Each long token is
tested under the encoding its characters suggest: chi-squared uniformity of the alphabet and of character classes, runs
and lag-one serial correlation. The null is ordinary language: tokens of letters alone, as the whole corpus has them,
by length band; p values of all tokens are counted in a bounded histogram, from which each band gets its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize

# Fixed values of the contract: the base patterns, in order, and the least length of what they find.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Tokens of this many characters or more are tested; a maximal run can't begin or end inside a longer one.
LEAST_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}+"
#: False-discovery rate within each length band.
RATE = 0.01
#: Mean and deviation of the null's statistic where a band has too few ordinary tokens to estimate them.
NULL_MEAN, NULL_SD, LEAST_NULL, LEAST_SD = 3.5, 0.4, 50, 0.15
#: Histogram steps for each power of ten of p, and the number of steps.
STEPS, MOST_STEPS = 10, 300

# The encodings' alphabets, in the order of their digits.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _found(text: Column, pattern: str) -> Column:
    """struct(m: matches, gaps: lengths of what stands between them) of a text; nothing where the pattern isn't."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(pattern), F.struct(m.alias("m"), gaps.alias("gaps")))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


_FOUND = ("assign", "access", "hex", "token")


def _with_starts(found: DataFrame, *kept: str) -> DataFrame:
    """kept columns, and for each of _FOUND its matches as struct(start, s): each begins after all gaps so far and all matches
    before. Sums run in blocks of the root of their number, so that n matches cost n times that root.

    What lambdas refer to is held as a column first, or they would work it out again for each element.
    """
    lengths = lambda f: F.zip_with(f"{f}.gaps", F.concat(F.array(F.lit(0)), F.transform(f"{f}.m", F.length)), lambda g, m: g + m)
    root = lambda f: F.greatest(F.ceil(F.sqrt(F.size(f"{f}.gaps").cast("double"))).cast("int"), F.lit(1))
    facts = found.select(*kept, _held(F.struct(*[F.when(F.col(f).isNotNull(), F.struct(F.col(f)["m"].alias("m"), lengths(f).alias("steps"), root(f).alias("b"))).alias(f) for f in _FOUND])).alias("f"))

    def blocks(f: str) -> Column:
        steps, b = F.col(f"f.{f}.steps"), F.col(f"f.{f}.b")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / b).cast("int")), lambda k: _sum(F.slice(steps, k * b + 1, b)))

    summed = facts.select(*kept, "f", _held(F.struct(*[F.when(F.col(f"f.{f}").isNotNull(), blocks(f)).alias(f) for f in _FOUND])).alias("g"))
    heads = lambda f: F.transform(F.col(f"g.{f}"), lambda x, k: _sum(F.slice(F.col(f"g.{f}"), F.lit(1), k)))
    headed = summed.select(*kept, "f", _held(F.struct(*[heads(f).alias(f) for f in _FOUND])).alias("h"))

    def starts(f: str) -> Column:
        steps, b = F.col(f"f.{f}.steps"), F.col(f"f.{f}.b")
        block = lambda i: F.floor(i / b).cast("int")
        at = lambda x, i: F.struct((F.get(F.col(f"h.{f}"), block(i)) + _sum(F.slice(steps, block(i) * b + 1, i - block(i) * b + 1))).alias("start"), x.alias("s"))
        return F.coalesce(F.transform(F.col(f"f.{f}.m"), at), F.array().cast("array<struct<start:int,s:string>>")).alias(f)

    return headed.select(*kept, *[starts(f) for f in _FOUND])


def _held(column: Column) -> Column:
    """A generated column: the optimizer doesn't write its expression again into each use (as in lambdas)."""
    return F.explode(F.array(column))


def _spans(found: str, kind: int, passes) -> Column:
    kept = F.filter(found, lambda x: passes(x["s"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["s"])).alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans in order, and the long tokens of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"),
        _held(F.struct(_found(text, ASSIGN).alias("assign"), _found(text, ACCESS).alias("access"), _found(text, HEX).alias("hex"), _found(text, TOKEN).alias("token"))).alias("x"),
    ).select("doc_id", "text_hash", "x.*")
    value = lambda s: F.length(F.regexp_extract(s, ASSIGN, 2)) >= LEAST_ASSIGN
    base = F.concat(_spans("assign", 0, value), _spans("access", 1, lambda s: F.length(s) >= LEAST_ACCESS), _spans("hex", 2, lambda s: F.lit(True)))
    return _with_starts(found, "doc_id", "text_hash").select("doc_id", "text_hash", F.array_sort(base).alias("base"), F.col("token").alias("tokens"))


def _free_tokens(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, s) of the tokens that no base span touches, from rows of one each text: along a text, no
    span that began before ends beyond the token's start, and none that begins later does so before its end."""
    key = ["doc_id", "text_hash"]
    alone = rows.filter("size(base) = 0").select(*key, F.inline("tokens"))
    both = rows.filter("size(base) > 0")
    whole = F.lit(None).cast("int")
    tokens = both.select(*key, F.inline("tokens")).select(*key, "start", "s", whole.alias("base_start"), whole.alias("base_end"))
    base = both.select(*key, F.inline("base")).select(*key, "start", F.lit(None).cast("string").alias("s"), F.col("start").alias("base_start"), F.col("end").alias("base_end"))
    along = Window.partitionBy(*key).orderBy("start")
    before = F.max("base_end").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("base_start").over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = tokens.union(base).withColumns({"before": before, "after": after}).filter("s IS NOT NULL")
    free = seen.filter("coalesce(before <= start, true) AND coalesce(after >= start + length(s), true)")
    return alone.union(free.select(*key, "start", "s"))


def _scores(tokens: DataFrame) -> DataFrame:
    """Adds band, plain (a token of the null) and stat, the tests' joint distance from randomness, to a table with s."""
    s = F.col("s")
    plain = s.rlike(r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[A-Za-z]+(?:[-_/][A-Za-z]+)+$")
    code = (
        F.when(plain, 36).when(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 16).when(s.rlike("^[A-Z2-7]+=*$"), 32)
        .when(s.rlike("^[0-9a-z]+$|^[0-9A-Z]+$"), 36).when(s.rlike("^[0-9A-Za-z]+$"), 62).otherwise(64)
    )
    t = tokens.withColumn("plain", plain).withColumn("k", code)
    body = F.when(F.col("k").isin(16, 36), F.lower(F.translate(s, "-_/=", ""))).otherwise(F.translate(s, "=", ""))
    alphabet = (
        F.when(F.col("k") == 16, DIGITS + LOWER[:6]).when(F.col("k") == 32, UPPER + "234567").when(F.col("k") == 36, DIGITS + LOWER).otherwise(UPPER + LOWER + DIGITS + "+/-_")
    )
    t = t.withColumn("body", body).withColumn("alphabet", alphabet).withColumn("n", F.greatest(F.length("body"), F.lit(2)).cast("double"))
    t = t.withColumn("codes", F.explode(F.array(F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")))))
    squares = F.aggregate(F.array_distinct("codes"), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter("codes", lambda y: y == x)).cast("double"), F.lit(2.0)))
    t = t.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n"))
    df = F.col("k") - 1.0
    uniform = (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # digits among the alphabet's characters: a share of 10 of 16, 6 of 32, 10 of 36, 10 of 62 or 64
    digit_share = F.when(F.col("k") == 32, 6 / 32).otherwise(10.0 / F.col("k"))
    digits = F.length(F.regexp_replace("body", "[^0-9]", "")).cast("double")
    classes = (digits - F.col("n") * digit_share) / F.sqrt(F.col("n") * digit_share * (1 - digit_share))
    # runs below and above the middle of the alphabet
    high = F.transform("codes", lambda x: F.when(x > F.col("k") / 2, "b").otherwise("a"))
    t = t.withColumn("bits", F.array_join(high, "")).withColumn("n1", F.length(F.regexp_replace("bits", "b", "")).cast("double"))
    n, n1 = F.col("n"), F.col("n1")
    n2 = n - n1
    expected = 1 + 2 * n1 * n2 / n
    spread = F.sqrt(F.greatest(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)), F.lit(1e-6)))
    runs = F.when((n1 == 0) | (n2 == 0), F.sqrt(n)).otherwise((F.length(F.regexp_replace("bits", "a+|b+", "x")) - expected) / F.greatest(spread, F.lit(0.1)))
    mean = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x) / n
    t = t.withColumn("mean", mean)
    pairs = F.zip_with("codes", F.slice("codes", 2, F.size("codes")), lambda x, y: (x - F.col("mean")) * (F.coalesce(y, F.col("mean")) - F.col("mean")))
    total = F.aggregate("codes", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mean"), F.lit(2.0)))
    serial = F.when(total == 0, F.sqrt(n)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / total * F.sqrt(n))
    stat = F.log1p(F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2.0)) + F.pow(classes, F.lit(2.0)) + F.pow(runs, F.lit(2.0)) + F.pow(serial, F.lit(2.0)))
    band = F.floor(2 * F.log2(F.length("s").cast("double"))).cast("int")
    return t.select(*tokens.columns, "plain", band.alias("band"), stat.alias("stat"))


def _steps(z: Column) -> Column:
    """Steps of -log10 of the lower tail at z, by an approximation of the normal tail."""
    x = F.abs(z)
    tail = 0.5 * F.exp(-0.717 * x - 0.416 * x * x)
    p = F.when(z < 0, tail).otherwise(1 - tail)
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(MOST_STEPS)).cast("int")


def random_tokens(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of tokens (with a column s) that differ from ordinary tokens at this false-discovery rate in their band."""
    scored = materialize(_scores(tokens), "tokens")
    ordinary = scored.filter("plain").groupBy("band").agg(F.count(F.lit(1)).alias("seen"), F.avg("stat").alias("m"), F.stddev_samp("stat").alias("d"))
    enough = F.col("seen") >= LEAST_NULL
    null = ordinary.select("band", F.when(enough, F.col("m")).alias("m"), F.when(enough, F.greatest("d", F.lit(LEAST_SD))).alias("d"))
    # one row a band; lengths of texts bound the number of bands (two for each power of two)
    z = (F.col("stat") - F.coalesce("m", F.lit(NULL_MEAN))) / F.coalesce("d", F.lit(NULL_SD))
    tested = scored.join(F.broadcast(null), "band", "left").withColumn("step", _steps(z)).drop("m", "d", "stat")
    counts = tested.groupBy("band", "step").agg(F.count(F.lit(1)).alias("k"))
    falling = Window.partitionBy("band").orderBy(F.col("step").desc())
    ranks = counts.withColumn("rank", F.sum("k").over(falling)).withColumn("all", F.sum("k").over(Window.partitionBy("band")))
    passing = ranks.filter(F.pow(F.lit(10.0), -F.col("step") / F.lit(float(STEPS))) <= rate * F.col("rank") / F.col("all"))
    least = passing.groupBy("band").agg(F.min("step").alias("least"))
    return tested.join(F.broadcast(least), "band").filter(F.col("step") >= F.col("least")).filter(~F.col("plain")).select(*tokens.columns)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind; a random token that touches a base
    span isn't added. Null texts are empty, with no spans; null ids stay; repeated rows give equal rows; an empty table gives
    no rows; other columns aren't read.
    """
    bare = materialize(_bare(docs), "spans")
    tokens = _free_tokens(bare.filter(F.size("tokens") > 0).dropDuplicates(["doc_id", "text_hash"]))
    span = F.struct("start", F.lit(3).alias("kind"), (F.col("start") + F.length("s")).alias("end"))
    added = random_tokens(tokens, rate).groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("random"))
    added = added.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "random")
    # only rows with long tokens are joined
    some, none = bare.filter(F.size("tokens") > 0), bare.filter(F.size("tokens") == 0)
    joined = some.join(added, some["doc_id"].eqNullSafe(added["of_id"]) & (some["text_hash"] == added["of_hash"]), "left").drop("of_id", "of_hash")
    rows = joined.unionByName(none.withColumn("random", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>")))
    random = F.coalesce("random", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", random))).alias("spans"), F.size(random).cast("long").alias("n_random"),
    )
