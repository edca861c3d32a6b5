"""What a run can tell beside its result: quantiles by mergeable sketches, and totals counted while a table is written."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Size of a sketch, and the error of its ranks that is counted on, as a share of all rows (sketches of size 200 keep it, too).
SKETCH_K, RANK_ERROR = 800, 0.0133


def sketches(df: DataFrame, by: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """(by, n, sketch): a KLL sketch of a column for each group, built before the exchange and merged after it, so a group of any
    size costs a few kilobytes a task. Nulls and NaN do not count; a group without numbers has no row."""
    x = F.col(column).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of several runs or days as one for each group."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(parts: DataFrame, at: list[float]) -> DataFrame:
    """The sketches' columns with (p, value) for each share in `at`: the value below which about that share lies."""
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in at))
    return parts.withColumn("q", F.explode(pairs)).select(*(c for c in parts.columns if c != "sketch"), "q.p", "q.value")


def rank_bounds(df: DataFrame, by: list[str], column: str, found: DataFrame) -> DataFrame:
    """`found` (by, p, value) with the exact shares of numbers below a value and up to it; one pass over df, a join with a row
    for each group, and one row per group and value out of each task."""
    x = F.col(column).cast("double")
    values = found.groupBy(*by).agg(F.collect_list(F.struct("p", "value")).alias("q"))  # as many as shares were asked for
    each = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("x")).join(values, by).withColumn("q", F.explode("q"))
    share = lambda cond: F.avg(cond.cast("double"))
    return each.groupBy(*by, "q.p", "q.value").agg(share(F.col("x") < F.col("q.value")).alias("below"), share(F.col("x") <= F.col("q.value")).alias("upto"))


class Totals:
    """Seconds and observed numbers of the stages of a run, added up by name.

    with totals.stage("pairs", edges, rows=F.count(F.lit(1))) as table:
        table.write.parquet(path)

    The numbers are counted by the write itself (`DataFrame.observe`), without another pass."""

    def __init__(self):
        self.values: dict[str, float] = {}

    def stage(self, name: str, df: DataFrame, **counts: Column) -> _Stage:
        return _Stage(self, name, df, counts)

    def add(self, key: str, value: float) -> None:
        self.values[key] = self.values.get(key, 0.0) + float(value)


class _Stage:
    def __init__(self, totals: Totals, name: str, df: DataFrame, counts: dict[str, Column]):
        self.totals, self.name, self.counts = totals, name, counts
        self.seen = Observation() if counts else None
        self.df = df.observe(self.seen, *(c.alias(k) for k, c in counts.items())) if counts else df

    def __enter__(self) -> DataFrame:
        self.began = time.monotonic()
        return self.df

    def __exit__(self, kind, error, trace) -> None:
        self.totals.add(f"{self.name}_seconds", time.monotonic() - self.began)
        if kind is None and self.seen:  # waits for the action; a stage that ran none is an error of its caller
            for k, v in self.seen.get.items():
                self.totals.add(f"{self.name}_{k}", v or 0)
