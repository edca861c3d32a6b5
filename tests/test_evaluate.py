import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe import __main__ as cli
from echoframe import schema
from echoframe.operators import evaluate, topk
from tests.test_operators import clips_df


def test_perfect_embeddings(spark):
    _, df = clips_df(spark, 12)
    same = topk.cosine_topk(df, 5)
    m = evaluate.in_set(df.select("clip_idx", "z"), same, [1, 5], 5, reference=same)
    assert m["R@1"] == m["jepa_R@5"] == m["mutual_knn_dtw"] == 1 and {"cknna_dtw", "cknna_jepa", "z_std", "z_effective_rank", "z_off_diag_mean"} <= set(m)


def test_pool_checks_and_names(spark):
    _, df = clips_df(spark, 12)
    z, table = df.select("clip_idx", "z"), topk.cosine_topk(df, 4)
    queries = z.where("clip_idx < 3")
    m = evaluate.against_pool(queries, z, table, [1], [3], "global")
    assert m["global_R@1"] == 1 and m["mutual_knn_dtw_global@3"] == 1 and abs(m["cknna_dtw_global@3"]) <= 1
    with pytest.raises(ValueError, match="needed"):
        evaluate.against_pool(queries, z, table, [1], [9], "global")
    with pytest.raises(ValueError, match="not in"):
        evaluate.against_pool(queries, z, table.where("clip_idx > 1"), [1], [3], "global")


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    hand = lambda: [(rng.normal(size=(21, 3)).tolist(),)]
    rows = [(v, n, f"u{v}{n}", {str(t): (hand(), hand()) for t in range(3)}) for v in (1, 2) for n in range(3)]
    path = {k: str(tmp_path / k) for k in ("k", "c", "n", "z")}
    spark.createDataFrame(rows, schema.KEYPOINTS).write.parquet(path["k"])
    cli.main(["clips", path["k"], path["c"], "--design", "pca_interjoint_dists"])
    cli.main(["neighbors", path["c"], path["n"], "--design", "pca_interjoint_dists", "--top-k", "3", "--candidate-k", "0", "--sanity-check"])
    c = spark.read.parquet(path["c"] + "/data")
    assert c.count() == 6 and len(c.first().frames[0]) == 160
    c.select("clip_idx", F.get("frames", F.lit(0)).alias("z")).write.parquet(path["z"])
    cli.main(["neighbors", path["c"], path["n"] + "2", "--design", "pca_interjoint_dists", "--top-k", "3", "--candidate-k", "5", "--index", "cells", "--partition-by", "rank", "--metrics", str(tmp_path / "t")])
    told = {r.name: r.value for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert told["neighbors_edges"] == 18 and told["neighbors_seconds"] > 0
    assert spark.read.parquet(path["n"] + "2/data").count() == 18
    cli.main(["evaluate", path["z"], path["n"], "--recall-k", "1", "--cknna-topk", "2", "--design", "pca_interjoint_dists", "--pool", "global", path["z"], path["n"], "--max-queries", "4"])
    pooled = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {"R@1", "global_R@1", "cknna_dtw_global@2", "mutual_knn_dtw_global@2"} <= set(pooled)
    with pytest.raises(ValueError):
        cli.main(["evaluate", path["z"], path["n"], "--design", "abs_21j_coords"])
    cli.main(["evaluate", path["z"], path["n"], "--recall-k", "1", "5", "--cknna-topk", "2", "--out", str(tmp_path / "m")])
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["R@5"] == 1 and spark.read.parquet(str(tmp_path / "m")).count() == len(printed)
