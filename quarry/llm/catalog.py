"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jaccard, line_dedup, lm, packing, secrets, substring_dedup, tiff, toxicity, urls
from quarry.llm.common import read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the rows of one fold are held out of training."""
    return lm.score(read(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 100-byte strings that begin earlier elsewhere."""
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), with_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labelled ones of the training folds."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, with the item and how much of it they hold."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs)


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as TIFF and read back."""
    return tiff.text_media(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2,048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return urls.judge(read(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose shingle sets link."""
    return jaccard.link(read(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_tiff_media": op6_tiff_media,
        "op7_packing": op7_packing,
        "op8_secret_scan": op8_secret_scan,
        "op9_url_filter": op9_url_filter,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.SQL, "op9_url_filter": urls.SQL}
