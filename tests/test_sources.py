import numpy as np
import pytest

from echoframe import schema
from echoframe.operators import topk
from echoframe.sources import artifacts, clips, features
from echoframe.streaming import incremental


def hand(x):
    return None if x is None else [([[float(x), 1.0, 2.0]],)]


def recording(video, node, frames):
    return (video, node, f"u{node}", None if frames is None else {k: (hand(left), hand(right)) for k, (left, right) in frames.items()})


def test_trajectories(spark):
    rows = [
        recording(2, 1, {"10": (3, 30), "2": (None, 20), "1": (1, None), "_meta": (99, 99)}),
        recording(1, 5, {"1": (1, 1)}),
        recording(1, 4, None),
    ]
    df = spark.createDataFrame(rows, schema.KEYPOINTS)
    got = clips.trajectories(df, joints=1).collect()
    assert len(got) == 1 and got[0].length == 3
    assert [f[0] for f in got[0].frames] == [1, 1, 3] and [f[3] for f in got[0].frames] == [20, 20, 30]
    assert clips.trajectories(df, joints=1, max_frames=2).first().length == 2


def test_second_detection_is_ignored(spark):
    two = [([[1.0, 0.0, 0.0]],), ([[7.0, 0.0, 0.0]],)]
    df = spark.createDataFrame([(1, 1, "u", {"1": (two, two), "2": (two, two)})], schema.KEYPOINTS)
    assert clips.trajectories(df, joints=1).first().frames[0][0] == 1


def test_first_videos_and_required_rows(spark):
    df = spark.createDataFrame([(3, 1), (1, 2), (1, 1), (2, 9)], "video_number int, node_number int")
    assert [tuple(r) for r in clips.first_videos(df, 2).collect()] == [(1, 1), (1, 2), (2, 9)]
    assert clips.first_videos(df).count() == 4
    with pytest.raises(ValueError):
        clips.require_rows(df.limit(0), "clips")


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.range(3)
    artifacts.write(df, path, {"design": "x", "top_k": 20})
    got, meta = artifacts.read(spark, path, design="x", top_k=5)
    assert got.count() == 3 and meta["top_k"] == 20
    for bad in ({"design": "y"}, {"top_k": 21}):
        with pytest.raises(ValueError):
            artifacts.read(spark, path, **bad)
    assert artifacts.reuse_or_build(spark, path, None, design="x")[2] is False
    build = lambda: (spark.range(2), {"design": "y"})
    assert artifacts.reuse_or_build(spark, str(tmp_path / "b"), build, design="y")[2] is True


def test_feature_files(spark, tmp_path):
    for v, u in ((1, "a"), (1, "b"), (2, "c")):
        (tmp_path / str(v)).mkdir(exist_ok=True)
        np.save(tmp_path / str(v) / f"{u}.npy", np.full((2, 3), v, dtype=np.float16))
    files = artifacts.feature_files(spark, str(tmp_path))
    assert sorted((r.video_number, r.node_uid) for r in files.collect()) == [(1, "a"), (1, "b"), (2, "c")]
    c = spark.createDataFrame([(1, "a"), (3, "z")], "video_number int, node_uid string")
    assert artifacts.with_features(c, files).count() == 1
    with pytest.raises(RuntimeError):
        artifacts.require_features(c, files)
    (tmp_path / "1" / "a.npy").write_bytes(b"not opened")
    t = artifacts.read_features(files.where("node_uid = 'c'")).first().tokens
    assert t == [[2.0] * 3] * 2


def test_feature_source(spark, tmp_path):
    want = {}
    for v in (1, 2, 10):
        (tmp_path / str(v)).mkdir()
        for u in "abcde":
            m = np.arange(v * ord(u) % 7 * 3, dtype=np.float16).reshape(-1, 3)  # some are empty
            np.save(tmp_path / str(v) / f"{u}.npy", m)
            want[v, u] = m.astype(float).tolist()
    (tmp_path / "1" / ".hidden.npy").write_bytes(b"")
    (tmp_path / "other").mkdir()
    root = str(tmp_path)
    got = lambda df: {(r.video_number, r.node_uid): r.tokens for r in df.collect()}
    assert got(features.read(spark, root)) == want and features.read(spark, root).count() == 15
    assert [tuple(r) for r in features.read(spark, f"file:{root}", "n_dims int, n_tokens int").distinct().collect()].count((3, 0)) == 1
    # Files that cannot be read show which are opened: none for names alone, and none that a filter rules out.
    for v, u in want:
        if (v, u) not in ((2, "b"), (2, "d")):
            (tmp_path / str(v) / f"{u}.npy").write_bytes(b"broken")
    assert features.read(spark, root, "node_uid string, video_number int").count() == 15
    for where in ("video_number = 2 AND node_uid IN ('b', 'd', 'zz')", "video_number > 1 AND video_number <= 9 AND node_uid IN ('d', 'b')"):
        assert got(features.read(spark, root).where(where)) == {k: t for k, t in want.items() if k in ((2, "b"), (2, "d"))}
    for where in ("video_number = 3", "video_number = 2 AND node_uid = '../2/b'", "node_uid = 'b' AND node_uid = 'd'"):
        assert features.read(spark, root).where(where).count() == 0
    # A condition that is not pushed holds all the same.
    assert features.read(spark, root, "video_number int, node_uid string").where("node_uid LIKE 'a%' OR video_number = 10").count() == 7
    with pytest.raises(Exception, match="broken|pickle|magic|Cannot load"):
        features.read(spark, root).where("video_number = 1").collect()


def test_feature_source_without_files(spark, tmp_path):
    assert features.read(spark, str(tmp_path)).collect() == []
    (tmp_path / "1").mkdir()
    np.save(tmp_path / "1" / "v.npy", np.zeros(3))
    with pytest.raises(Exception, match="no matrix"):
        features.read(spark, str(tmp_path)).collect()


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("top_k: 7\nunknown: 1\ndata_dir: d\nrecall_k: [1, 2]\n")
    c = artifacts.Config.load(str(p))
    assert c.top_k == 7 and c.data_dir == str(tmp_path / "d") and c.recall_k == (1, 2)


def test_metrics_sink(spark, tmp_path):
    for e in (0, 1):
        artifacts.append_metrics(spark, str(tmp_path / "m"), "r", e, {"a": e})
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_schema_check(spark):
    with pytest.raises(ValueError):
        schema.check_schema(spark.range(1), schema.NEIGHBORS)
    assert schema.check_schema(spark.createDataFrame([(1, 1, 2, 0.5, "x")], "clip_idx int, rank int, neighbor_idx int, dtw_sim double, more string"), schema.NEIGHBORS).dtypes[0] == ("clip_idx", "bigint")


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=(int(rng.integers(1, 5)), 2)).tolist()) for i in range(n)]


def test_incremental_equals_full(spark):
    df = spark.createDataFrame(rows(14), "clip_idx long, frames array<array<double>>")
    old, new = df.where("clip_idx < 9"), df.where("clip_idx >= 9")
    key = lambda t: sorted((r.clip_idx, r.rank, r.neighbor_idx) for r in t.collect())
    assert key(incremental.extend(topk.dtw_topk(old, 3), old, new, 3)) == key(topk.dtw_topk(df, 3))


def test_stream_appends_and_restarts(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    df = spark.createDataFrame(rows(14), "clip_idx long, frames array<array<double>>")
    key = lambda t: sorted(tuple(r)[:3] for r in t.collect())

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
        q = incremental.maintain(stream, out, 3, str(tmp_path / "cp"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    df.where("clip_idx < 5").coalesce(1).write.parquet(str(src / "0"))
    run()
    assert key(incremental.neighbors(spark, out, 3)) == key(topk.dtw_topk(df.where("clip_idx < 5"), 3))
    before = files()
    # Clips that are known, and one that comes twice in a batch, after a restart from the checkpoint.
    df.where("clip_idx >= 3 AND clip_idx < 9").unionByName(df.where("clip_idx = 7")).coalesce(1).write.parquet(str(src / "1"))
    run()
    df.where("clip_idx >= 9").coalesce(1).write.parquet(str(src / "2"))
    run()
    assert key(incremental.neighbors(spark, out, 3)) == key(topk.dtw_topk(df, 3))
    assert before.items() <= files().items()  # nothing that was there is rewritten
    incremental.compact(spark, out, str(tmp_path / "folded"), 3)
    assert key(incremental.neighbors(spark, str(tmp_path / "folded"), 3)) == key(topk.dtw_topk(df, 3))
    assert spark.read.parquet(str(tmp_path / "folded" / "edges")).count() == 14 * 3
