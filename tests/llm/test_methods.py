"""What the operators' methods must hold to whatever the division of the work: brute force, invariance and recall."""

import base64
import hashlib
import math
import random
import string
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, graph, line_dedup, lm, secrets, substring_dedup, urls
from quarry.llm.common import settings
from test_operators import brute_repeats


def test_components_that_are_not_done_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(edges, most_rounds=1)


# operator 1


def test_each_corpus_has_its_own_model(spark):
    one = spark.createDataFrame([(k, "aa bb " * 30) for k in range(40)], "doc_id long, text string")
    two = spark.createDataFrame([(k, "aa cc " * 30) for k in range(40)], "doc_id long, text string")
    asked = [lm.score(d).filter("doc_id = 3").first()["score"] for d in (one, two, one)]
    assert asked[0] == asked[2]
    both = spark.createDataFrame([(k, ("aa bb " if k % 2 else "aa cc ") * 30) for k in range(40)], "doc_id long, text string")
    assert lm.score(both).filter("doc_id = 3").first()["score"] != asked[0]


def test_word_probabilities_sum_to_one(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeg", k=draw.randint(1, 5))) for _ in range(400)]
    texts = [(k, " ".join(draw.choices(words, k=50))) for k in range(60)]
    counts = lm.count_words(spark.createDataFrame(texts, "doc_id long, text string"))
    vocab = lm.vocabulary(counts, shortlist=50)
    rows = {r["token"].encode(): r["n"] for r in counts.collect()}
    tables = lm.Tables.of(lm.fresh_params(vocab.noise))
    context = [np.array([5], np.int16), np.array([700], np.int16)]
    p = lambda i: math.exp(float(tables.log_prob(np.array([i], np.int16), context)[0]))
    total = p(lm.END) + sum(p(i) for i in vocab.ids.values())
    of_class = Counter()
    for word, n in rows.items():
        if word and word not in vocab.ids:
            of_class[lm.class_id(word)] += (n + 1) / 10 ** vocab.inside[lm.class_id(word) - 1]
    # each class has one more place, for words that weren't seen
    total += sum(p(c) * (of_class[c] + 1 / 10 ** vocab.inside[c - 1]) for c in range(1, lm.CLASSES + 1))
    assert abs(total - 1) < 1e-4 and len(vocab.ids) == 50


# operator 2


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A phrase that stands in many texts with other surroundings, copies of its surroundings, and repeated ids."""
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choices(string.ascii_letters + " ", k=n))
    phrase = "Licensed under the terms that the whole of this long sentence states"
    sides = [(noise(40), noise(40)) for _ in range(12)]
    rows = []
    for k in range(90):
        a, b = draw.choice(sides) if k % 3 else (noise(40), noise(40))
        rows.append((k // 2, f"{noise(60)}{a}{phrase}{b}{noise(60)}"))
    rows += [(7, rows[14][1]), (None, rows[20][1])]
    path = str(tmp_path_factory.mktemp("crowd") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    return spark.read.parquet(path)


def removals(docs, **options):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.dedup(docs, with_text=False, **options).collect())


def test_crowded_anchors_lose_no_string(spark, crowd):
    # the table's order: files by name, rows by place
    ordered = crowd.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").collect()
    ordered.sort(key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["file_path"], r["row_index"]))
    expected = Counter((r["doc_id"], *x) for r, x in zip(ordered, brute_repeats([(r["doc_id"], r["text"]) for r in ordered]), strict=True))
    for most in (2048, 20, 2):
        assert removals(crowd, crowd=most) == expected


def test_repeats_do_not_depend_on_the_division_into_tasks(spark, crowd):
    found = []
    for n in ("1", "7"):
        with settings(spark, {"spark.sql.files.minPartitionNum": n, "spark.sql.shuffle.partitions": n}):
            found.append(removals(crowd))
    assert found[0] == found[1]


# operator 4

_NAME = regex.compile(r"(?<=[\p{L}\d,;:]\s)\p{Lu}[\p{L}\p{M}'’-]*")
_UNIT = regex.compile(rf"(?i)(?<![\p{{L}}\d.,])[$€£]?({decontaminate._NUMBER})\s?({decontaminate.UNITS})(?![\p{{L}}\d])")
_BARE = regex.compile(rf"(?<![\p{{L}}\d.,{decontaminate.VALUE}])[$€£]?{decontaminate._NUMBER}(?![\p{{L}}\d])")


def brute_words(text):
    """(kind, value) of each template word; kind is the word itself where it is no slot."""
    s, v = decontaminate.SLOT, decontaminate.VALUE
    t = _NAME.sub(lambda m: f" {s}name{v}{m[0]}", text or "")
    t = _BARE.sub(lambda m: f" {s}num{v}{m[0]} ", _UNIT.sub(lambda m: f" {s}num{v}{m[1]} {s}unit{v}{m[2]} ", t))
    words = regex.sub(r'[.,;:!?"()\[\]{}<>«»“”]+', "", t).lower().split()
    return [tuple(w.split(v, 1)) if w.startswith(s) else (w, None) for w in words]


def brute_leaks(docs, items):
    out = set()
    for doc_id, text in docs:
        theirs = brute_words(text)
        for item_id, item in items:
            mine = brute_words(item)
            n = min(len(mine), decontaminate.WORDS)
            kinds = lambda words, k: tuple(x for x, _ in words[k : k + n])
            slots = lambda k: sum(v is not None for _, v in mine[k : k + n])
            first = {}
            for j in range(len(mine) - n + 1):
                if 2 * slots(j) <= n:
                    first.setdefault(kinds(mine, j), j)
            assert first, "every item of this fixture has windows with few slots"
            need = min(math.ceil(len(first) * decontaminate.SHARE), decontaminate.ENOUGH_WINDOWS)
            shifts = {}
            for i in range(len(theirs) - n + 1):
                j = first.get(kinds(theirs, i))
                if j is not None:
                    shifts.setdefault(i - j, set()).add(j)
            held, changed = set(), False
            for shift, js in shifts.items():
                values = {}
                for j in js:
                    for k in range(j, j + n):
                        if mine[k][1] is not None:
                            values.setdefault(mine[k], set()).add(theirs[k + shift])
                good = all(len(v) == 1 for v in values.values())
                js = js if good else {j for j in js if not slots(j)}
                if js:
                    held |= js
                    changed |= not good or any(m not in v for m, v in values.items())
            if len(held) >= need:
                out.add((doc_id, item_id, len(first), len(held), "reparameterised" if changed else "verbatim"))
    return out


def test_decontamination_against_brute_force(spark):
    draw = random.Random(8)
    shapes = [
        "if the boy {a} walks {x} km to the old mill and then his sister {b} walks {y} km more, how far did {a} and she go in {z} hours altogether",
        "the farmer {a} sells {x} kg of red apples to the baker {b} for {y} dollars, how much would he pay for {z} kg of the same apples tomorrow",
        "wenn der {a} am morgen {x} meter weit läuft und danach noch einmal {y} meter mit dem {b} geht, wie weit ist er dann nach {z} minuten gekommen",
        "a train leaves the station at {x} minutes past and another one at {y} minutes past, when do they meet if the way is {z} miles long",
    ]
    names = ["Anna", "Bernd", "Chloé", "Dmitri", "Élodie", "Hund", "Nachbar"]
    fill = lambda s: s.format(a=draw.choice(names), b=draw.choice(names), x=draw.randint(2, 99), y=draw.randint(2, 99), z=draw.randint(2, 99))
    items = [(k, fill(s)) for k, s in enumerate(shapes)] + [(9, "which of these seven words is here")]
    lorem = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    docs = []
    for k in range(40):
        parts = [lorem(20), draw.choice([items[k % 5][1], fill(shapes[k % 4]), fill(shapes[k % 4]).replace("and", "und"), " ".join(items[k % 4][1].split()[:12]), lorem(9)]), lorem(5)]
        docs.append((k, " ".join(parts)))
    twisted = items[0][1].replace(items[0][1].split()[3], "Zora", 1)  # one of two mentions of a name
    docs += [(50, f"{lorem(4)} {twisted}"), (51, None), (52, ""), (53, items[2][1].upper())]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r)[:5] for r in decontaminate.leaks(*frames).select("doc_id", "item_id", "n_windows", "n_found", "kind").collect()}
    assert found == brute_leaks(docs, items) and {k for *_, k in found} == {"verbatim", "reparameterised"}


# operator 5


def test_salted_lines_equal_broadcast_ones(spark):
    rows = [(k, f"Menu\nline {k}\nFooter {k % 2}", f"h{k % 2}") for k in range(60)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("of_salt", F.lit(1)).withColumn("salt", F.lit(2))
    one, two = (line_dedup.drop_boilerplate(pages, broadcast_limit=n) for n in (1 << 20, 0))
    assert one.columns == two.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert all("Menu" not in r["text"] for r in one.collect())


# operator 8


def planted(draw, kind):
    data = draw.randbytes(48)
    n = draw.randint(20, 64)
    return {
        "base64": base64.b64encode(data).decode()[:n], "base64url": base64.urlsafe_b64encode(data).decode()[:n], "base32": base64.b32encode(data).decode()[:n],
        "hex": hashlib.sha256(data).hexdigest().upper()[:n], "short hex": hashlib.sha256(data).hexdigest()[: draw.randint(20, 23)], "letters and digits": "".join(draw.choices(string.ascii_letters + string.digits, k=n)),
    }[kind]


def test_random_tokens_are_found_among_words(spark):
    draw = random.Random(12)
    syllables = ["ver", "ein", "lich", "keit", "schaft", "ung", "zu", "auf", "heit", "be", "ge", "trag", "sicht", "nahme", "recht", "able", "tion", "inter"]
    words = ["".join(draw.choices(syllables, k=draw.randint(5, 9))) for _ in range(600)]
    docs, truth = [], {}
    kinds = ["base64", "base64url", "base32", "hex", "short hex", "letters and digits"]
    for k in range(600):
        text = f"the word {words[k]} stands here"
        if k % 5 == 0:
            truth[k] = kinds[k // 5 % len(kinds)]
            text += f" beside {planted(draw, truth[k])} and others"
        docs.append((k, text))
    found = {r["doc_id"]: r["n_random"] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    caught = Counter(truth[k] for k in truth if found[k])
    recall = {kind: caught[kind] / sum(v == kind for v in truth.values()) for kind in kinds}
    assert sum(caught.values()) >= 0.9 * len(truth), recall
    assert sum(found[k] > 0 for k in found if k not in truth) <= 6, "clean texts"


def test_many_matches_take_time_in_proportion(spark):
    one = " ".join(f"secret: value{k:05d} {hashlib.md5(str(k).encode()).hexdigest()} x{'Q9z' * 8}{k}" for k in range(6000))
    began = time.monotonic()
    row = secrets.scan(spark.createDataFrame([(1, one)], "doc_id long, text string")).first()
    assert (row["n_assign"], row["n_hex"]) == (6000, 6000) and time.monotonic() - began < 60
    spans = [s.split(":") for s in row["spans"].split(",")]
    assert all(one[int(a) : int(b)].startswith({"assign": "secret", "hex": one[int(a)]}.get(kind, one[int(a)])) for kind, a, b in spans)


# operator 9


def test_links_of_all_kinds_against_sql(spark, tmp_path):
    canonical = lambda h: f'<link rel="canonical" href="{h}">'
    refresh = lambda h: f"<meta http-equiv='refresh' content='0; url={h}'>"
    rows = [
        (1, "http://a.com/de/1", ""), (2, "http://x.net/p?id=1", canonical("http://a.com/de/1")), (3, "http://x.net/p?id=2", ""), (4, "http://x.net/q", refresh("?id=7")), (5, "http://x.net/q?id=7#top", canonical("//a.com/de/2")),
        (6, "http://y.net/dir/one", canonical("two")), (7, "http://y.net/dir/two", refresh("/three")), (8, "http://y.net/three", canonical("https://a.com/de/4?z#f")), (9, "http://z.net", canonical("index")), (10, "http://z.net/index", canonical("#top")),
        (11, "http://w.net/1", canonical("http://b.org/ok")), (12, "http://w.net/2", canonical("http://w.net/1")), (13, "http://w.net/2", refresh("http://a.com/de/9")), (14, None, canonical("http://a.com/de/1")), (15, "mailto:x", canonical("/x")),
        (16, "HTTP://Y.NET/dir/one", None), (17, "http://v.net/a b", canonical("http://v.net/c")), (18, "http://v.net/c", canonical("http://example.org/es/1")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    expected = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({urls.SQL})").fetchall(), key=str)
    found = sorted((tuple(r) for r in urls.judge(pages).select(columns).collect()), key=str)
    assert found == expected
    verdicts = {r[0]: r[4] for r in found}
    blocked = {k for k, v in verdicts.items() if v == "block"}
    assert {1, 2, 4, 5, 6, 7, 8, 16, 17, 18} <= blocked and not {3, 9, 10, 11, 12, 13, 14, 15} & blocked


# the pipeline


def test_stages_take_nulls_empties_repeats_and_clashes(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, gone_id long, toxicity double"
    text = "some quite ordinary words that stand in this text"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words of no id", None, "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (5, text, "en", None, 1), (6, "long " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 7, 8, 9, 0.5) for r in rows], schema)
    spark.createDataFrame([(4, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "an item of no id whose words are nowhere else at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), name)
            assert now.columns == docs.columns
        left = [r["doc_id"] for r in now.collect()]
        if frame is docs:
            assert sorted(left, key=str) == sorted([1, 2, None, 4, 4, 6], key=str)
            assert {r["n_lines"] for r in now.collect()} == {7} and {r["toxicity"] for r in now.collect()} == {0.5}
        else:
            assert left == []
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert {r["doc_id"] for r in packed.collect()} == set(left)
