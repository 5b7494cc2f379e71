"""Exact quantiles of large columns and of large groups: no task holds all of a group's values.

Values are counted, the counts dealt by ranges of (keys, value), and each range's place in its group taken from a table of
one row for each range and group; ranks are then looked up within the ranges.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources.scratch import kept


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """keys, then q0, q1 and so on: the quantiles of the non-null values of each group, interpolated between neighbours.

    Groups without values are left out; nulls are keys like others. Without keys, all rows are one group.
    """
    k = [f"__k{n}" for n in range(len(keys))]
    counted = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, k, strict=True)], F.col(f"`{value}`").cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*k, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # written once: where a range begins depends on a sample, and all steps must see the same ranges
    placed = kept(counted.repartitionByRange(*k, "__v").withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*k, "__part").agg(F.sum("__c").alias("__s"))
    of_group = Window.partitionBy(*k)
    along = of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.withColumns({"__before": F.coalesce(F.sum("__s").over(along), F.lit(0)), "__n": F.sum("__s").over(of_group)})
    within = Window.partitionBy("__part", *k).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k], F.col("a.__part") == F.col("b.__part"))
    joined = placed.alias("a").join(ranges.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in k], "a.__part", "__v", "__c", "__before", "__n")
    end = F.col("__before") + F.sum("__c").over(within)
    ranked = joined.withColumn("__end", end).withColumn("__begin", F.col("__end") - F.col("__c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__begin") <= rank) & (rank < F.col("__end")), F.col("__v")))

    exprs = []
    for n, share in enumerate(shares):
        position = (F.col("__n") - 1) * F.lit(float(share))
        exprs += [at(F.floor(position)).alias(f"__lo{n}"), at(F.ceil(position)).alias(f"__hi{n}")]
    found = ranked.groupBy(*k).agg(F.max("__n").alias("__n"), *exprs).filter("__n IS NOT NULL")
    out = []
    for n, share in enumerate(shares):
        position = (F.col("__n") - 1) * F.lit(float(share))
        low, high, up = F.col(f"__lo{n}"), F.col(f"__hi{n}"), position - F.floor(position)
        out.append(F.when(low == high, low).otherwise((1 - up) * low + up * high).alias(f"q{n}"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], *out)


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """left with a column of right (one row for each key, nulls being keys too) under a name; null where right has no row."""
    marks = [f"__r{n}" for n in range(len(keys))]
    found = right.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(keys, marks, strict=True)], F.col(column).alias(name))
    if not keys:
        return left.crossJoin(F.broadcast(found)) if found.first() is not None else left.withColumn(name, F.lit(None).cast("double"))  # one row
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(m)) for c, m in zip(keys, marks, strict=True)])
    return left.join(found, same, "left").drop(*marks)
