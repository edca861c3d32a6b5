"""Neighbour tables that grow with a stream of clips.

Clips and edges are append-only: a micro-batch adds its new clips and the edges that they bring, and rewrites nothing.
The table of the moment is the k best of all edges; `compact` folds what batches have added into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.best import EDGES, best
from ..operators.topk import dtw_between, dtw_topk, ranked

CLIPS = "clip_idx long, frames array<array<double>>"


def _edges(table: DataFrame) -> DataFrame:
    return table.select("clip_idx", "neighbor_idx", F.col("dtw_sim").alias("sim"))


def merge(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """The k best of two tables' edges; commutative and associative, repeated edges count once."""
    return ranked(_edges(old).unionByName(_edges(new)).dropDuplicates(["clip_idx", "neighbor_idx"]), k)


def arrivals(corpus: DataFrame, arrived: DataFrame, k: int) -> DataFrame:
    """The edges that arrived clips bring, k at most of each clip: among themselves, and with the corpus both ways; each pair is
    computed once, and none of the corpus alone."""
    among = _edges(dtw_topk(arrived, k))
    across = best(dtw_between(arrived, corpus, k), k).select("clip_idx", "neighbor_idx", "sim")
    return among.unionByName(across)


def extend(table: DataFrame, corpus: DataFrame, arrived: DataFrame, k: int) -> DataFrame:
    """The table of corpus and arrived clips, from that of the corpus."""
    return ranked(_edges(table).unionByName(arrivals(corpus, arrived, k)), k)


def neighbors(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The neighbour table of all clips that <path> holds."""
    return ranked(spark.read.schema(f"{EDGES}, batch long").parquet(f"{path}/edges").drop("batch").dropDuplicates(["clip_idx", "neighbor_idx"]), k)


def compact(spark: SparkSession, path: str, out: str, k: int) -> None:
    """Writes the k best edges of each clip, as one batch, under another path; clips are copied with it."""
    _edges(neighbors(spark, path, k)).write.mode("overwrite").parquet(f"{out}/edges/batch=-1")
    spark.read.schema(f"{CLIPS}, batch long").parquet(f"{path}/clips").drop("batch").write.mode("overwrite").parquet(f"{out}/clips/batch=-1")


def maintain(stream: DataFrame, path: str, k: int, checkpoint: str):
    """Starts a query that adds each micro-batch n to <path>/clips/batch=<n> and <path>/edges/batch=<n>. A batch that is run
    again writes the same folders; clips that are there already, or twice in a batch, are passed over. A batch costs
    the pairs that its clips are in, and writes k edges at most for each clip that they are near."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        fresh = batch.select("clip_idx", "frames").dropDuplicates(["clip_idx"])
        earlier = None
        if n or _exists(spark, f"{path}/clips"):
            earlier = spark.read.schema(f"{CLIPS}, batch long").parquet(f"{path}/clips").where(F.col("batch") < n).drop("batch")
            fresh = fresh.join(earlier.select("clip_idx"), "clip_idx", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/clips/batch={n}")
        fresh = spark.read.schema(CLIPS).parquet(f"{path}/clips/batch={n}")
        edges = _edges(dtw_topk(fresh, k)) if earlier is None else arrivals(earlier, fresh, k)
        edges.write.mode("overwrite").parquet(f"{path}/edges/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
