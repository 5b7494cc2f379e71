"""Boilerplate lines by their frequency within a site: DataFrame operations only.

A line is dropped from every page of a host when more than a given share of the host's pages have it. Counting combines
before its shuffle, so a host with a third of all pages, or a line on all of them, costs one row a task. The lines to
drop are at most (mean lines a page / ratio) for each host; they are broadcast if their counted size allows, and else
joined with the pages by host and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_LIMIT_BYTES, fresh, materialize, quoted, small_enough

RATIO = 0.1
MIN_PAGES = 5
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, host_pages): lines, by hash, on more than ratio of a host's pages and on min_pages or more."""
    listed = pages.select(F.col(quoted(host)).alias("host"), F.array_distinct(F.transform(F.filter(_lines(F.col(quoted(text))), lambda x: F.trim(x) != ""), _line_key)).alias("lines"))
    totals = listed.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = listed.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    t = totals.withColumnRenamed("host", "of")
    return counts.join(t, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("pages") > ratio * F.col("host_pages")).drop("of")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """All rows and columns of pages with text less its boilerplate lines, plus n_lines and n_dropped.

    Lines are parts between newlines, compared after trimming spaces; blank lines are never dropped. A null text is
    empty (one blank line); null hosts are one host; a line repeated in a page counts once for it; repeated rows are pages of their own; an
    empty table gives no rows. If pages has columns n_lines or n_dropped, the new ones take a leading underscore.
    """
    found = materialize(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    known, lines = fresh(pages, "known_lines"), fresh(pages, "split_lines")
    n_lines, n_dropped = fresh(pages, "n_lines"), fresh(pages, "n_dropped")
    of, salt, of_salt = fresh(pages, "of_host"), fresh(pages, "salt"), fresh(pages, "of_salt")
    by_host = found.groupBy(F.col("host").alias(of)).agg(F.collect_set("line").alias(known))
    if small_enough(found, row_bytes=64, limit=broadcast_limit):
        joined = pages.join(F.broadcast(by_host), F.col(quoted(host)).eqNullSafe(F.col(of)), "left")
    else:
        salted = pages.withColumn(salt, F.pmod(F.xxhash64(F.col(quoted(text))), F.lit(SALTS)).cast("int"))
        spread = by_host.withColumn(of_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, F.col(quoted(host)).eqNullSafe(F.col(of)) & (F.col(salt) == F.col(of_salt)), "left").drop(salt, of_salt)
    split = joined.withColumn(lines, _lines(F.col(quoted(text))))
    kept = F.when(F.col(known).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(known), _line_key(x))))
    out = split.withColumn(text, kept)
    return out.select(
        *[F.array_join(F.col(quoted(c)), "\n").alias(c) if c == text else F.col(quoted(c)) for c in pages.columns],
        F.size(lines).cast("long").alias(n_lines), (F.size(lines) - F.size(F.col(quoted(text)))).cast("long").alias(n_dropped),
    )


SQL = f"""
WITH totals AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
parts AS (SELECT doc_id, source, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
counts AS (SELECT source, line, count(DISTINCT doc_id) AS k FROM parts WHERE line <> '' GROUP BY source, line),
known AS (
  SELECT c.source, list(c.line) AS found FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.k >= {MIN_PAGES} AND c.k > {RATIO} * t.n GROUP BY c.source),
split AS (
  SELECT d.doc_id, d.source, string_split(coalesce(d.text, ''), chr(10)) AS ls, coalesce(k.found, []) AS found
  FROM documents d LEFT JOIN known k ON d.source IS NOT DISTINCT FROM k.source),
kept AS (SELECT doc_id, source, ls, list_filter(ls, lambda x: NOT list_contains(found, trim(x))) AS left_ FROM split)
SELECT doc_id, source, array_to_string(left_, chr(10)) AS text, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(left_) AS BIGINT) AS n_dropped FROM kept
"""
