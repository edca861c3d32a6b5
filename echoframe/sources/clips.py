"""Clips from tables: keypoint recordings, and stand-ins over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_videos(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of the first n videos by number (all, if None), ordered by video and node."""
    if n is not None:
        videos = rows.select("video_number").distinct().orderBy("video_number").limit(n)
        rows = rows.join(videos, "video_number", "left_semi")
    return rows.orderBy("video_number", "node_number")


def trajectories(rows: DataFrame, fill: str = "ffill", max_frames: int | None = T.MAX_FRAMES, min_frames: int = T.MIN_FRAMES, joints: int = T.JOINTS) -> DataFrame:
    """Keypoint recordings -> clips with `frames` (left hand, then right) and `length`.

    Frames are ordered by number, `_meta` is no frame, and the first detection of a hand counts; a hand is missing
    where its first coordinate is. Recordings without keypoints or with fewer than `min_frames` frames go.
    """
    width = 3 * joints
    entries = F.map_entries(F.map_filter("keypoints_per_frame", lambda k, v: k != "_meta"))
    by_number = F.array_sort(entries, lambda a, b: F.signum(a["key"].cast("int") - b["key"].cast("int")).cast("int"))

    def hand(side: str):
        def first(e):
            flat = F.flatten(F.get(e["value"][side], F.lit(0))["kpts_3d"])
            x = F.get(flat, F.lit(0))
            return F.when(x.isNotNull() & ~F.isnan(x), flat)

        return F.transform("ordered", first)

    found = rows.where(F.col("keypoints_per_frame").isNotNull()).withColumn("ordered", by_number).where(F.size("ordered") >= min_frames)
    found = found.withColumns({"left": T.gap_fill(hand("L"), width, fill), "right": T.gap_fill(hand("R"), width, fill)})
    frames = F.zip_with("left", "right", lambda a, b: F.concat(a, b))
    found = found.withColumn("frames", frames if max_frames is None else T.truncate(frames, max_frames))
    return found.drop("ordered", "left", "right", "keypoints_per_frame").withColumn("length", F.size("frames"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


# Stand-ins over the sample tables.


def embedding_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_idx, video_number, z (64 numbers), length 4..16, frames of 4 numbers."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_idx"), F.col("label").alias("video_number"), F.col("embedding").cast("array<double>").alias("z"), (4 + F.col("vec_id") % 13).cast("int").alias("length"))
    return e.withColumn("frames", F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda t: F.slice("z", 4 * t + 1, F.lit(4))))


def event_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoint recordings of one joint per hand from each user's events in time order: the left hand
    is missing on errors and views, the right on signups."""
    e = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1)
    coord = lambda a, b, c: F.array(F.struct(F.array(F.array(a, b, c)).alias("kpts_3d")))
    none = F.lit(None).cast("array<struct<kpts_3d:array<array<double>>>>")
    k = F.get_json_object("props", "$.k").cast("double")
    left = F.when(~F.col("event_type").isin("error", "view"), coord(F.col("value"), k, F.col("frame").cast("double"))).otherwise(none)
    right = F.when(F.col("event_type") != "signup", coord(k, F.col("value"), -F.col("frame").cast("double"))).otherwise(none)
    entry = F.struct(F.col("frame").cast("string").alias("key"), F.struct(left.alias("L"), right.alias("R")).alias("value"))
    rows = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("keypoints_per_frame"))
    return rows.select((F.col("user_id") % 10).cast("int").alias("video_number"), F.col("user_id").cast("int").alias("node_number"), F.col("user_id").cast("string").alias("node_uid"), "keypoints_per_frame")


def two_hand_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """126-number frames: even vectors are left hands, odd ones right; ten frames make a clip."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 63).alias("v"))
    left = e.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("f"), F.col("v").alias("l"))
    right = e.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("f"), F.col("v").alias("r"))
    frames = left.join(right, "f").select(F.expr("f div 10").alias("clip_idx"), F.struct("f", F.concat("l", "r").alias("x")).alias("s"))
    return frames.groupBy("clip_idx").agg(F.sort_array(F.collect_list("s")).alias("s")).select("clip_idx", F.col("s.x").alias("frames"))


def order_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip per order: its lines in order as frames of (quantity, price / 1000, discount)."""
    li = table(spark, sf_dir, "lineitem")
    frame = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"), F.col("l_discount").cast("double").alias("d"))
    rows = li.groupBy(F.col("l_orderkey").alias("clip_idx")).agg(F.sort_array(F.collect_list(frame)).alias("s"))
    return rows.select("clip_idx", F.transform("s", lambda x: F.array(x["q"], x["p"] / 1000, x["d"])).alias("frames"), F.size("s").alias("length"))
