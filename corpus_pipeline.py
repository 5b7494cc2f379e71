"""From raw documents to packed training sequences, in five stages; each takes what the one before kept.

Null and empty texts are documents like others: nothing in them is toxic, boilerplate, a copy or a benchmark item, so they
stay, and are packed as their end token. Null ids stay. Rows that repeat an id and a text go or stay together in the stages
that drop rows, but for the near-duplicate stage, where rows of one id are one document. Ties go to the least id. Empty
tables pass through, and columns besides those of documents are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from quarry.llm.catalog import TOKENIZER
from quarry.llm.common import discard, materialize, quoted, read


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rejected documents go. Evidence is learned from the labelled ones among docs."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: boilerplate lines of a source go; every document stays. n_chars, if there, is counted anew."""
    kept = line_dedup.drop_boilerplate(docs).select(*[quoted(c) for c in docs.columns])
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group stays."""
    return jaccard.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of the remaining documents in training windows."""
    return packing.pack(docs, TOKENIZER, with_ids=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_filter),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_filter),
    ("packing", packed),
]

#: SQL can't express the learned scores or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep. Each stage's result but the last is written and read again, and goes
    when the next one is there."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
