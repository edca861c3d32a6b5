"""python -m echoframe {clips,neighbors,evaluate} ...: artifacts from Parquet tables."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.transforms import TRANSFORMS, design, joint_layout
from .operators import evaluate, observed, sampler, topk
from .sources import artifacts, clips


def build_clips(spark, a) -> None:
    rows = clips.first_videos(spark.read.parquet(a.keypoints), a.videos)
    found = clips.require_rows(clips.trajectories(rows, a.fill), "clips")
    if a.features:
        found = clips.require_rows(artifacts.with_features(found, artifacts.feature_files(spark, a.features)), "clips with features")
    found = found.withColumn("clip_idx", F.xxhash64("video_number", "node_number", "node_uid"))
    if a.max_clips:
        found = sampler.sample(found, a.max_clips, a.seed)
    width = len(found.select(F.get("frames", F.lit(0)).alias("f")).first().f)
    joint_layout(width)
    found = found.withColumn("frames", TRANSFORMS[design(a.design).transform](F.col("frames"), width))
    artifacts.write(found, a.out, {"design": a.design})


def build_neighbors(spark, a) -> None:
    table, _ = artifacts.read(spark, a.clips, design=a.design)
    edges, meta = topk.build(table, a.top_k, a.candidate_k, a.pooling, a.design, index=a.index)
    totals = observed.Totals()
    with totals.stage("neighbors", edges, edges=F.count(F.lit(1))) as counted:
        artifacts.write(counted, a.out, meta, a.partition_by)
    if a.metrics:
        artifacts.append_metrics(spark, a.metrics, a.run_name, 0, totals.values)
    if a.sanity_check:
        # A sample of queries against all clips; the built table's rows of these.
        queries = sampler.sample(table, a.sanity_queries, a.seed)
        approx = artifacts.read(spark, a.out)[0].join(queries.select("clip_idx"), "clip_idx", "left_semi")
        print(topk.sanity_check(approx, topk.dtw_against(queries, table, a.top_k), a.top_k).first().asDict())


def run_evaluation(spark, a) -> None:
    want = {"design": a.design} if a.design else {}
    target, _ = artifacts.read(spark, a.neighbors, **want)
    vectors = spark.read.parquet(a.embeddings)
    values = evaluate.in_set(vectors, target, a.recall_k, a.cknna_topk)
    for name, corpus, neighbors in a.pool:
        # Queries against a larger corpus that holds them, by its own neighbour table.
        queries = sampler.sample(vectors, a.max_queries, a.seed)
        values |= evaluate.against_pool(queries, spark.read.parquet(corpus), artifacts.read(spark, neighbors, **want)[0], a.recall_k, a.cknna_topk, name)
    print(json.dumps(values, sort_keys=True))
    if a.out:
        artifacts.append_metrics(spark, a.out, a.run_name, a.epoch, values)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="echoframe", description=__doc__)
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("clips")
    c.set_defaults(run=build_clips)
    for name, kw in (("keypoints", {}), ("out", {}), ("--design", {"default": "abs_21j_coords"}), ("--videos", {"type": int}), ("--features", {}), ("--max-clips", {"type": int, "default": 0}), ("--fill", {"default": "ffill"}), ("--seed", {"type": int, "default": 42})):
        c.add_argument(name, **kw)
    n = sub.add_parser("neighbors")
    n.set_defaults(run=build_neighbors)
    for name, kw in (("clips", {}), ("out", {}), ("--design", {"default": "abs_21j_coords"}), ("--top-k", {"type": int, "default": 20}), ("--candidate-k", {"type": int, "default": 100}), ("--pooling", {"default": "stats4"}), ("--partition-by", {"nargs": "+"}), ("--index", {"default": "exhaustive", "choices": sorted(topk.INDEXES)}), ("--metrics", {}), ("--run", {"default": "run", "dest": "run_name"}), ("--sanity-check", {"action": "store_true"}), ("--sanity-queries", {"type": int, "default": 1000}), ("--seed", {"type": int, "default": 42})):
        n.add_argument(name, **kw)
    e = sub.add_parser("evaluate")
    e.set_defaults(run=run_evaluation)
    for name, kw in (("embeddings", {}), ("neighbors", {}), ("--out", {}), ("--run", {"default": "run", "dest": "run_name"}), ("--epoch", {"type": int, "default": 0}), ("--recall-k", {"type": int, "nargs": "+", "default": [1, 5, 10, 20]}), ("--cknna-topk", {"type": int, "nargs": "+", "default": [10]}), ("--design", {}), ("--pool", {"nargs": 3, "action": "append", "default": [], "metavar": ("NAME", "CORPUS", "NEIGHBORS")}), ("--max-queries", {"type": int, "default": 0}), ("--seed", {"type": int, "default": 42})):
        e.add_argument(name, **kw)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    a.run(spark, a)


if __name__ == "__main__":
    main()
