"""The pipeline's stages on a small table, and its contract."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    item = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for k in range(200):
        text = " ".join(word() for _ in range(60))
        if k % 10 == 0:
            text = f"nitwit {text} buffoon"
        if k == 33:
            text += " " + item
        rows.append((k, f"Site menu\n{text}", "en", f"src{k % 2}", 0))
        labels.append((k, 1, int(k % 10 == 0)))
    rows.append((200, rows[7][1], "en", "src0", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in kept.items()}
    clean = {k for k in range(201) if k % 10 or k == 200}
    assert ids["toxicity"] == ids["line_dedup"] == clean and ids["ngram_jaccard"] == clean - {200} and ids["decontamination"] == ids["packing"] == clean - {200, 33}
    assert not any("Site menu" in r["text"] or r["n_chars"] != len(r["text"]) for r in kept["line_dedup"].collect())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids["packing"]
