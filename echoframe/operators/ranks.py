"""Exact ranks and exact "first n in random order" without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Hexadecimal digits that a level of `first_n` tells apart, and rows that are few enough to sort in one task.
DIGITS, FEW = 3, 50_000


def ordinal(df: DataFrame, order: Sequence[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with the rank of each row from 1 on, by columns that tell all rows apart, in two levels.

    Rows are dealt to ranges of the order and written, so that both levels see the same ranges even where a task is run
    again; the counts of the ranges, one row each, give each range its offset, and rows are numbered within their
    range. A value that many rows share is split among ranges by the columns after it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("_place", F.row_number().over(within)).join(F.broadcast(offsets), "_range").withColumn(out, F.col("_offset") + F.col("_place")).drop("_range", "_place", "_offset")  # `n` rows are broadcast


def first_n(df: DataFrame, n: int, order: Column, key: str) -> Column:
    """The condition that holds for the first n rows by a column of hexadecimal text and a key, which together tell rows apart.

    Rows are counted by the first digits of the order, then those of the group in which the n-th row falls by the next
    digits, until few are left to sort: what a filter needs is the n-th row itself. The driver gets the counts of
    16 ** DIGITS groups at a level. Null keys are never among the first.
    """
    if n <= 0:
        return F.lit(False)
    rows, seen, prefix = df.select(order.alias("h"), F.col(key).alias("k")).where(F.col(key).isNotNull()), 0, ""
    while True:
        width = len(prefix) + DIGITS
        counts = sorted((r.p, r.n) for r in rows.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count("*").alias("n")).collect())
        for p, here in counts:
            if seen + here >= n:
                break
            seen += here
        else:
            return F.col(key).isNotNull()  # no more than n rows
        prefix, rows = p, rows.where(F.col("h").startswith(p))
        if here <= FEW or len(prefix) >= 32:
            break
    last = rows.orderBy("h", "k").limit(n - seen).agg(F.max(F.struct("h", "k")).alias("m")).first().m
    return (order < last.h) | ((order == last.h) & (F.col(key) <= last.k))
