import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.operators import cells, losses, metrics, model, pruned, sampler, topk
from echoframe.functions import dtw as dtw_


def clips_df(spark, n=23, seed=0, d=3, t=6):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 4, rng.normal(size=(int(rng.integers(1, t + 1)), d)).tolist(), (lambda z: (z / np.linalg.norm(z)).tolist())(rng.normal(size=5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "clip_idx long, video_number int, frames array<array<double>>, z array<double>")


def matrix(rows):
    f = [np.array(r[2]) for r in rows]
    n = len(f)
    x, y = (i.ravel() for i in np.indices((n, n)))
    return -dtw_.distances(f, f, (x, y)).reshape(n, n)


def brute_top(sim, k, ids=None):
    out = {}
    for i in range(len(sim)):
        order = [j for j in np.lexsort((np.arange(len(sim)), -np.round(sim[i], 9))) if j != i and (ids is None or j in ids)]
        out[i] = order[:k]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.clip_idx, r.rank)):
        out.setdefault(r.clip_idx, []).append(r.neighbor_idx)
    return out


@pytest.mark.parametrize(("k", "rows"), [(3, 5), (5, 512), (40, 7)])
def test_dtw_topk_against_brute_force(spark, k, rows):
    data, df = clips_df(spark)
    assert as_dict(topk.dtw_topk(df, k, rows=rows)) == brute_top(matrix(data), k)


@pytest.mark.parametrize("rows", [4, 100])
def test_cosine_topk_against_brute_force(spark, rows):
    data, df = clips_df(spark)
    z = np.array([r[3] for r in data])
    assert as_dict(topk.cosine_topk(df, 4, rows=rows)) == brute_top(z @ z.T, 4)


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [[1.0]]) for i in range(5)], "clip_idx long, frames array<array<double>>")
    assert as_dict(topk.dtw_topk(df, 2, rows=2)) == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1]}


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        topk.dtw_topk(clips_df(spark, 3)[1], 0)


def test_empty_and_single(spark):
    _, df = clips_df(spark, 3)
    assert topk.dtw_topk(df.limit(0), 2).count() == 0 and topk.dtw_topk(df.where("clip_idx = 0"), 2).count() == 0


@pytest.mark.parametrize("rows", [4, 30])
def test_pairs_by_block_and_by_pair_agree(spark, rows):
    data, df = clips_df(spark)
    pairs = spark.createDataFrame([(i, j) for i in range(23) for j in range(0, 23, 2) if i != j], "clip_idx long, neighbor_idx long")
    m = matrix(data)
    for some in (topk.dtw_pairs(pairs, df), topk.dtw_pairs(pairs, df, per_clip=100, rows=rows)):
        got = {(r.clip_idx, r.neighbor_idx): r.sim for r in some.collect()}
        assert len(got) == pairs.count() and all(math.isclose(got[i, j], m[i, j], abs_tol=1e-9) for i, j in got)


@pytest.mark.parametrize("rows", [5, 100])
def test_both_tables_of_one_pass(spark, rows):
    data, df = clips_df(spark)
    train = [i for i in range(23) if i % 3]
    both = topk.dtw_topk_with_train(df, df.where("clip_idx % 3 != 0"), 4, rows=rows)
    assert as_dict(both[0]) == brute_top(matrix(data), 4)
    assert as_dict(both[1]) == {i: x for i, x in brute_top(matrix(data), 4, set(train)).items() if i in train}


def test_gather_and_train_queries(spark):
    _, df = clips_df(spark)
    places = spark.createDataFrame([(0, 5), (1, 5), (2, 3)], "slot int, position long")
    rows = df.select(F.col("clip_idx").alias("position"), "video_number")
    assert sorted((r.slot, r.position) for r in sampler.gather(rows, places).collect()) == [(0, 5), (1, 5), (2, 3)]
    assert sampler.gather(rows, places.limit(0)).count() == 0
    assert sampler.train_queries(df, 5, 1).collect() == sampler.sample(df, 5, 2).collect()


def test_recall_counts_negative_ids(spark):
    e = spark.createDataFrame([(-5, 1, -7), (-7, 1, -5), (3, 1, -5)], "clip_idx long, rank int, neighbor_idx long")
    got = {r.k: r.recall for r in metrics.recall_at(e, e, e.select("clip_idx"), [1]).collect()}
    assert got == {1: 1.0}


def test_filter_and_refine_is_exact_with_all_candidates(spark):
    _, df = clips_df(spark)
    assert as_dict(topk.filtered_topk(df, 3, 22)) == as_dict(topk.dtw_topk(df, 3))
    s = topk.sanity_check(topk.dtw_topk(df, 3), topk.dtw_topk(df, 3), 3).first()
    assert (s["mean"], s["min"], s["max"]) == (1, 1, 1)


def test_queries_against_corpus(spark):
    data, df = clips_df(spark)
    got = as_dict(topk.dtw_against(df.where("clip_idx < 4"), df.where("clip_idx >= 2"), 3, rows=6))
    want = brute_top(matrix(data), 3, set(range(2, 23)))
    assert got == {i: want[i] for i in range(4)}


def test_train_pool_cites_train_only(spark):
    data, df = clips_df(spark)
    train = df.where("clip_idx % 2 = 1")
    got = as_dict(topk.train_pool(df, train, 4))
    ids = set(range(1, 23, 2))
    assert set(got) == ids and got == {i: v for i, v in brute_top(matrix(data), 4, ids).items() if i in ids}


def test_build_metadata(spark):
    _, df = clips_df(spark, 6)
    assert topk.build(df, 2, 0)[1]["dtw_mode"] == "exact_all_pairs"
    assert topk.build(df, 2, 3)[1] == {"design": "abs_21j_coords", "top_k": 2, "candidate_k": 3, "pooling": "stats4", "dtw_mode": "exact", "n": 6}


def edges(spark, table, sims=None):
    rows = [(i, k + 1, j, float(sims[i][k]) if sims else 1.0) for i, row in enumerate(table) for k, j in enumerate(row) if j >= 0]
    return spark.createDataFrame(rows, "clip_idx long, rank int, neighbor_idx long, sim double")


def test_recall_examples(spark):
    q = spark.createDataFrame([(0,), (1,)], "clip_idx long")
    m, t = edges(spark, [[1, 2, 3], [4, 5, 6]]), edges(spark, [[1, 2, 3], [7, 8, 6]])
    got = {r.k: r.recall for r in metrics.recall_at(m, t, q, [1, 2, 3], 3).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0}
    padded = {r.k: r.recall for r in metrics.recall_at(edges(spark, [[1, -1], [-1, -1]]), edges(spark, [[1, 2], [3, 4]]), q, [1, 2], 2).collect()}
    assert padded == {1: 0.5, 2: 0.5}


def test_centred_product_against_dense(spark):
    rng = np.random.default_rng(0)
    x, y = (np.where(rng.random((4, 7)) < 0.4, rng.normal(size=(4, 7)), 0) for _ in range(2))
    df = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i int, j int, x double")
    centre = lambda m: m - m.mean(0) - m.mean(1, keepdims=True) + m.mean()
    assert math.isclose(metrics.centred_product(df(x), df(y), 4, 7).first()[0], (centre(x) * centre(y)).sum(), abs_tol=1e-9)


def dense_hsic(k, l):
    k, l = k - np.diag(np.diag(k)), l - np.diag(np.diag(l))
    m = len(k)
    return ((k * l.T).sum() + k.sum() * l.sum() / ((m - 1) * (m - 2)) - 2 * (k.sum(0) @ l.sum(1)) / (m - 2)) / (m * (m - 3))


def test_cknna_against_dense(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(9, 9)) for _ in range(2))
    mask = lambda s, k: np.array([[j in np.argsort(-np.where(np.arange(9) == i, -np.inf, s[i]))[:k] for j in range(9)] for i in range(9)], float)
    ma, mb = mask(a, 4), mask(b, 4)
    table = lambda m, s: [[int(j) for j in np.argsort(-np.where(m[i] > 0, s[i], -np.inf))[:4]] for i in range(9)]
    ta, tb = table(ma, a), table(mb, b)
    model_, target = edges(spark, ta, [[a[i][j] for j in ta[i]] for i in range(9)]), edges(spark, tb)
    want_aa, want_bb = dense_hsic(ma * a, ma * a), dense_hsic(mb, mb)
    want = dense_hsic(ma * mb * a, ma * mb) / math.sqrt(want_aa * want_bb) if want_aa > 0 and want_bb > 0 else 0.0
    assert math.isclose(metrics.cknna(model_, target, 4, 9).first()[0], want, abs_tol=1e-9)
    with pytest.raises(ValueError):
        metrics.hsic(model_.selectExpr("clip_idx i", "neighbor_idx j", "sim x"), model_.selectExpr("clip_idx i", "neighbor_idx j", "sim x"), 3)


def test_identical_and_disjoint_neighbourhoods(spark):
    a, b = edges(spark, [[1, 2], [0, 2], [0, 1]]), edges(spark, [[3, 4], [3, 4], [3, 4]])
    assert metrics.mutual_knn(a, a, 2, 3).first()[0] == 1 and metrics.mutual_knn(a, b, 2, 3).first()[0] == 0
    assert math.isclose(metrics.pool_cknna(a, a, 2, 3, 6).first()[0], 1) and metrics.pool_cknna(a, b, 2, 3, 6).first()[0] == 0


def test_health(spark):
    x = np.random.default_rng(0).normal(size=(30, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "z array<double>").repartition(3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    assert math.isclose(metrics.effective_rank(df), math.exp(-(p * np.log(p)).sum()), rel_tol=1e-6)
    assert math.isclose(metrics.z_std(df).first()[0], x.std(0, ddof=1).mean())
    g = (x @ x.T)[~np.eye(30, dtype=bool)]
    o = metrics.off_diagonal_of(df).first()
    assert np.allclose([o.off_diag_mean, o.off_diag_std], [g.mean(), g.std(ddof=1)])


def test_spearman_maximum_is_below_one(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(10)], "i int, a double, b double")
    assert math.isclose(metrics.spearman(df, "a", "b", ["i"]).first()[0], 0.9)


def test_contiguity(spark):
    assert metrics.check_contiguous(spark.range(5).withColumnRenamed("id", "clip_idx")) == 5
    with pytest.raises(ValueError):
        metrics.check_contiguous(spark.range(1, 5).withColumnRenamed("id", "clip_idx"))


def test_selection_metric():
    assert metrics.selection_metric({"cknna_dtw": 0.3}, True, 10) == 0.3
    assert math.isclose(metrics.selection_metric({"R@5": 0.5, "jepa_R@5": 1.0}, False, 10), 2 / 3, rel_tol=1e-6)


def test_alignment_loss_against_numpy(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(6, 4))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    t = rng.normal(size=(6, 6))
    t = t + t.T
    rows = [(0, i, j, float(z[i] @ z[j]), float(t[i, j])) for i in range(6) for j in range(6)]
    got = losses.alignment(spark.createDataFrame(rows, "batch int, i int, j int, p double, t double"), "p", "t", 0.1, 0.5).first()
    up = t[np.triu_indices(6, 1)]
    tn = (t - up.mean()) / (up.std(ddof=1) + 1e-8)
    off = ~np.eye(6, dtype=bool)
    soft = lambda x: np.exp(x - x.max(1, keepdims=True)) * off / (np.exp(x - x.max(1, keepdims=True)) * off).sum(1, keepdims=True)
    q, p = soft(tn / 0.5), soft(z @ z.T / 0.1)
    ce = -(q[off] * np.log(p[off])).reshape(6, 5).sum(1).mean()
    h = -(q[off] * np.log(q[off] + 1e-12)).reshape(6, 5).sum(1).mean()
    assert np.allclose([got.loss, got.entropy], [ce, h]) and got.kl >= 0


def test_set_rank_needs_cached_candidates(spark):
    members = spark.createDataFrame([(0, 0, 0, "anchor", 0), (0, 0, 1, "positive", 1), (0, 0, 2, "boundary", 2)], "batch int, anchor long, slot int, role string, clip_idx long")
    sims = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1)], "clip_idx long, neighbor_idx long, sim double")
    cache = lambda rows: spark.createDataFrame(rows, "clip_idx long, rank int, neighbor_idx long, dtw_sim double")
    got = losses.set_rank(members, sims, cache([(0, 1, 1, -0.1), (0, 2, 2, -0.5)]), 1, 1).first()
    assert got.set_violation == 0 and got.rank_violation == 0 and math.isclose(got.positive_margin, 0.8)
    tie = losses.set_rank(members, sims, cache([(0, 1, 1, -0.5), (0, 2, 2, -0.5)]), 1, 1).first()
    assert tie.rank_loss == 0
    with pytest.raises(Exception, match="neighbour cache"):
        losses.set_rank(members, sims, cache([(0, 1, 1, -0.1)]), 1, 1).collect()


def test_split_sizes(spark):
    c = spark.range(100).withColumnRenamed("id", "clip_idx")
    train, held = sampler.split(c, 0.13, 1)
    assert (train.count(), held.count()) == (87, 13) and train.join(held, "clip_idx").count() == 0
    assert [len(x) for x in sampler.split_positions(100, 0.1, 0)] == [90, 10]
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            sampler.n_eval(10, bad)


def test_rank_range_sample_order(spark):
    e = spark.createDataFrame([(0, r, r) for r in range(1, 8)], "clip_idx long, rank int, neighbor_idx long")
    c = spark.range(8).select(F.col("id").alias("clip_idx"), F.col("id").cast("int").alias("video_number"))
    got = [r.neighbor_idx for r in sampler.rank_range_sample(e, c, c, 3, 6, 2, 9).orderBy("place").collect()]
    assert got == sorted(range(3, 7), key=lambda j: sampler.md5_order(9, 0, j))[:2]


def test_soft_dtw_tends_to_hard():
    x, y = np.random.default_rng(0).normal(size=(2, 3, 5, 2))
    r = np.full((6, 6), np.inf)
    r[0, 0] = 0
    c = ((x[0][:, None] - y[0][None]) ** 2).sum(-1)
    for i in range(5):
        for j in range(5):
            r[i + 1, j + 1] = c[i, j] + min(r[i, j], r[i, j + 1], r[i + 1, j])
    assert math.isclose(model.soft_dtw(x, y, 1e-4)[0], r[5, 5], abs_tol=1e-2)


def test_projection_masks_padding(spark):
    w = model.random_weights(3, 8, 4, 2, 2)
    x = np.random.default_rng(0).normal(size=(1, 5, 3))
    alone = model.project(x, None, w, 2, 2)
    padded = model.project(np.concatenate([x, np.full((1, 2, 3), 9.0)], 1), np.array([[True] * 5 + [False] * 2]), w, 2, 2)
    assert np.allclose(alone, padded) and np.isclose(np.linalg.norm(alone), 1)
    _, df = clips_df(spark, 5)
    z = model.encode(df, lambda a, m: model.project(a, m, w, 2, 2)).collect()
    assert len(z) == 5 and all(math.isclose(sum(v * v for v in r.z), 1) for r in z)
    with pytest.raises(ValueError):
        model.model_input(df, "other")
    with pytest.raises(ValueError):
        model.prototype_activations(x, {"prototypes": np.zeros((1, 2, 4))})


def test_weights_round_trip(tmp_path):
    w = model.random_weights(2, 4, 3, 1, 1)
    model.save_weights(str(tmp_path / "w.npz"), w)
    back = model.load_weights(str(tmp_path / "w.npz"))
    assert set(back) == set(w) and all(np.array_equal(back[k], w[k]) for k in w)


def walks(spark, groups=8, each=30, d=3, seed=4):
    """Clips in groups that lie apart, of 3 to 20 frames."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = 40 * rng.normal(size=d) + np.cumsum(rng.normal(size=(20, d)), 0)
        rows += [(g * each + i, (base[: rng.integers(3, 21)] + 0.3 * rng.normal(size=d)).tolist()) for i in range(each)]
    rows += [(10_000, rows[0][1]), (10_001, rows[0][1])]  # equal clips tie
    return rows, spark.createDataFrame(rows, "clip_idx long, frames array<array<double>>")


@pytest.mark.parametrize("d", [3, 12])
def test_cross_and_bounds(d):
    rng = np.random.default_rng(d)
    a, b = ([rng.normal(size=(int(rng.integers(1, 9)), d)) for _ in range(n)] for n in (20, 17))
    b[3] = a[2].copy()
    x, y = (i.ravel() for i in np.indices((20, 17)))
    for norm in dtw_.NORMS:
        want = dtw_.distances(a, b, (x, y), norm=norm).reshape(20, 17)
        assert np.allclose(dtw_.cross(a, b, norm=norm), want, atol=1e-9) and dtw_.cross(a, b)[2, 3] == 0
        bound = dtw_.Bounds(a, 3).distances(dtw_.Bounds(b, 3), norm)
        assert (bound <= want).all() and bound.max() > 0
    needed = rng.random((20, 17)) < 0.1
    assert np.allclose(dtw_.cross(a, b, needed)[needed], dtw_.cross(a, b)[needed])
    with pytest.raises(ValueError):
        dtw_.cross([np.zeros((0, d))], b)
    with pytest.raises(ValueError):
        dtw_.cross(a, b, norm="other")


@pytest.mark.parametrize(("rows", "n_cells"), [(16, 9), (512, None), (7, 1)])
def test_pruned_table_is_the_exact_one(spark, rows, n_cells):
    _, df = walks(spark)
    got, report = pruned.dtw_topk_pruned(df, 4, n_cells=n_cells, rows=rows)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(tuple(r)[:3] for r in topk.dtw_topk(df, 4).collect())
    r = report.first()
    assert r.clip_pairs == 242 * 241 // 2 and r.clip_pairs_within <= r.clip_pairs
    if rows == 16:
        assert r.pruned_share > 0.7 and r.block_pairs_met < r.block_pairs
    few, _ = pruned.dtw_topk_pruned(df.limit(3), 4)
    assert few.count() == 6 and pruned.dtw_topk_pruned(df.limit(1), 4)[0].count() == 0


def test_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    z = centres[rng.integers(0, 12, 600)] + 0.25 * rng.normal(size=(600, 8))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z[500:] = z[500]  # many rows of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "clip_idx long, z array<double>")
    exact = topk.cosine_topk(df, 5)
    everywhere = cells.cell_topk(df, 5, n_cells=12, probes=99, rows=50)
    assert sorted(tuple(r)[:3] for r in everywhere.collect()) == sorted(tuple(r)[:3] for r in exact.collect())
    some = cells.cell_topk(df, 5, n_cells=12, rows=50)
    near = topk.sanity_check(some.where("clip_idx < 500"), exact.where("clip_idx < 500"), 5).first()
    assert near["mean"] >= 0.95
    dealt = cells.assign(df, cells.fit(df, 12), 12)
    assert cells.probes_for(dealt, 5) < 12 and cells.probes_for(dealt, 5, 1.0) >= cells.probes_for(dealt, 5, 0.5)
    assert cells.cell_topk(df.limit(0), 5).count() == 0 and cells.cell_topk(df.limit(1), 5).count() == 0
    with pytest.raises(ValueError):
        topk.filtered_topk(df, 1, 1, index="other")


def test_cells_feed_filter_and_refine(spark):
    _, df = walks(spark)
    exact, found = topk.dtw_topk(df, 5), topk.filtered_topk(df, 5, 40, index="cells")
    assert topk.sanity_check(found, exact, 5).first()["mean"] >= 0.9


def test_cosine_against_leaves_queries_alone(spark):
    rows, df = clips_df(spark, 30)
    got = topk.cosine_against(df.where("clip_idx < 5"), df, 4, rows=7)
    want = topk.cosine_topk(df, 4).where("clip_idx < 5")
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(tuple(r)[:3] for r in want.collect())


def test_sketches_and_totals(spark, tmp_path):
    from echoframe.operators import observed

    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").when(F.col("id") < 19_999, "cold").otherwise("none").alias("g"), F.when(F.col("id") < 19_999, F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([("cold", float("nan")), (None, 1.0)], "g string, x double"))
    parts = observed.sketches(df.withColumn("day", F.pmod(F.hash("x"), F.lit(3))), ["g", "day"], "x")
    found = observed.quantiles(observed.merged(parts, ["g"]), [0.0, 0.1, 0.5, 1.0])
    assert {(r.g, r.n) for r in found.collect()} == {("hot", 15_000), ("cold", 4_999), (None, 1)}
    for r in observed.rank_bounds(df, ["g"], "x", found).collect():
        assert r.below - observed.RANK_ERROR <= r.p <= r.upto + observed.RANK_ERROR
    assert observed.sketches(df.limit(0), ["g"], "x").collect() == []
    totals = observed.Totals()
    for k in range(2):
        with totals.stage("pairs", df, rows=F.count(F.lit(1)), hot=F.count_if(F.col("g") == "hot")) as table:
            table.write.parquet(str(tmp_path / str(k)))
    assert totals.values["pairs_rows"] == 40_004 and totals.values["pairs_hot"] == 30_000 and totals.values["pairs_seconds"] > 0


@pytest.mark.parametrize("norm", ["mean_length", "none"])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_few_pairs_are_computed_in_double_precision(monkeypatch, norm, shift):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    f = [rng.normal(size=(int(rng.integers(2, 9)), 4)) + shift for _ in range(400)]
    f[7], f[300] = f[11].copy(), f[11].copy()  # ties
    t = pa.table({"clip_idx": np.arange(400), "frames": [x.tolist() for x in f]})
    left, right = t.slice(0, 200), t.slice(200)
    sim = -dtw_.cross(f, f, None, "symmetric2", norm)
    computed = []
    run = dtw_.distances
    monkeypatch.setattr(dtw_, "distances", lambda *a: computed.append(len(a[2][0])) or run(*a))
    monkeypatch.setattr(dtw_, "cross", lambda *a: pytest.fail("all pairs in double precision"))
    for a, b, same in ((left, right, False), (left, left, True)):
        got = {}
        for r in topk.nearest(a, b, same, 5, "symmetric2", norm).to_pylist():
            got.setdefault(r["clip_idx"], []).append(r["neighbor_idx"])
        sides = [(a, b)] if same else [(a, b), (b, a)]
        for x, y in sides:
            ids, others = x["clip_idx"].to_numpy(), y["clip_idx"].to_numpy()
            for i in ids:
                rest = others[others != i]
                assert got[i] == list(rest[np.lexsort((rest, -np.round(sim[i, rest], 9)))][:5])
    assert max(computed) < 200 * 200 / 4
    quick, room = dtw_.quick(f[:200], f[200:], norm)
    off = quick - -sim[:200, 200:]
    assert off.max() <= room and off.min() >= -room


@pytest.mark.parametrize("counted", [True, False])
def test_blocks_of_a_group_meet_in_one_task(monkeypatch, counted):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    f = [rng.normal(size=(int(rng.integers(2, 9)), 4)) for _ in range(240)]
    ids, block = rng.permutation(240), np.arange(240) % 8
    t = pa.table({"block": block, "clip_idx": ids, "frames": [x.tolist() for x in f], "limit": np.full(240, np.inf)})
    met = {i: [j for j in range(i + 1, 8) if (i, j) != (2, 5)] for i in range(7)}
    monkeypatch.setattr(pruned, "TRIED", 1)
    got, within = pruned._meet(t, met, 3, "symmetric2", "mean_length", counted)
    sim = -dtw_.cross(f, f)
    apart = (block[:, None] == block[None]) | (np.minimum.outer(block, block) == 2) & (np.maximum.outer(block, block) == 5)
    sim[apart] = -np.inf
    want = {int(ids[a]): [int(ids[b]) for b in np.lexsort((ids, -np.round(sim[a], 9)))[:3]] for a in range(240)}
    found = {}
    for r in got.to_pylist():
        found.setdefault(r["clip_idx"], []).append(r["neighbor_idx"])
    assert found == want
    assert not counted or within == (~apart).sum() // 2


def test_k_best_by_strips(monkeypatch):
    from echoframe.operators import best as best_

    rng = np.random.default_rng(3)
    sim = np.round(rng.normal(size=(30, 40)), 1) + rng.normal(size=(30, 40)) * 1e-11  # ties at 9 places
    sim[4, :38], sim[5] = -np.inf, -np.inf
    others = rng.permutation(40)
    monkeypatch.setattr(best_, "STRIP_CELLS", 100)
    got = {}
    for r in best_.k_best(np.arange(30), others, sim, 6).to_pylist():
        got.setdefault(r["clip_idx"], []).append(r["neighbor_idx"])
    for i in range(30):
        order = [j for j in np.lexsort((others, -np.round(sim[i], 9))) if sim[i, j] > -np.inf][:6]
        assert got.get(i, []) == [others[j] for j in order]


def test_groups_leave_k_edges_a_row(spark):
    """What leaves a pair of groups is the k best of each row, however many blocks it has, and pairs with frames are dealt by number."""
    from echoframe.operators import best

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    x[40:60] = x[:20]  # ties
    ids = np.arange(90) * 3
    sim = x @ x.T

    def met(li, ri, same, rows):
        def score(i, j, mine, theirs):
            part = sim[np.ix_(li[i] // 3, ri[j] // 3)]
            part[li[i][:, None] == ri[j][None]] = -np.inf
            mine.offer(part, ri[j])
            if theirs is not None:
                theirs.offer(part.T, li[i])

        return best.running(li, ri, same, 5, rows, score).to_pylist()

    for left, right, same in ((ids, ids, True), (ids[:50], ids[50:], False)):
        want, got = met(left, right, same, 100), met(left, right, same, 7)
        assert len(got) == 90 * 5 and sorted(map(str, got)) == sorted(map(str, want))
    rows, df = clips_df(spark, 40)
    edges = topk.dtw_pairs(topk.cosine_topk(df, 5), df, per_clip=5)
    assert {(r.clip_idx, r.neighbor_idx) for r in edges.collect()} == {(r.clip_idx, r.neighbor_idx) for r in topk.cosine_topk(df, 5).collect()}


def test_each_pair_of_blocks_has_a_task(spark):
    """Dealt by hash, several pairs of blocks fell to one task and some tasks had none."""
    import pyarrow as pa

    from echoframe.operators import blocks

    df = spark.range(300).select((F.col("id") * 7 - 50).alias("clip_idx"))

    def run(left, right, same):
        from pyspark import TaskContext

        a, b = (t["clip_idx"].to_numpy() for t in (left, left if same else right))
        i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
        keep = i < j if same else i != j
        n = keep.sum()
        return pa.table({"task": np.full(n, TaskContext.get().partitionId()), "pair": np.full(n, min(a.min(), b.min()) * 10_000 + max(a.min(), b.min())), "i": i[keep], "j": j[keep]})

    got = blocks.block_pairs(df, "clip_idx", run, "task long, pair long, i long, j long", 30).toPandas()
    met = set(zip(np.minimum(got.i, got.j), np.maximum(got.i, got.j)))
    assert len(got) == len(met) == 300 * 299 // 2
    assert (got.groupby("task").pair.nunique() == 1).all() and got.task.nunique() == got.pair.nunique() >= 55


@pytest.mark.parametrize("copies", [2, 150])
def test_slices_of_a_group_share_what_rules_pairs_out(monkeypatch, copies):
    """Double precision is asked for what the k best of a whole group leave, not of each of its slices; large groups of copies too."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    f = [rng.normal(size=(int(rng.integers(2, 9)), 4)) for _ in range(800)]
    for i in range(copies):
        f[i * 5] = f[0].copy()
    t = pa.table({"clip_idx": np.arange(800) * 3, "frames": [x.tolist() for x in f]})
    sim = -dtw_.cross(f, f)
    computed = []
    run = dtw_.distances
    monkeypatch.setattr(dtw_, "distances", lambda *a: computed.append(len(a[2][0])) or run(*a))
    for a, b, same in ((t.slice(0, 400), t.slice(400), False), (t, t, True)):
        per = {}
        for near in (1000, 60):
            monkeypatch.setattr(topk, "NEAR", near)
            computed.clear()
            got = {}
            for r in topk.nearest(a, b, same, 5).to_pylist():
                got.setdefault(r["clip_idx"], []).append((r["neighbor_idx"], r["sim"]))
            per[near] = sum(computed)
            for x, y in [(a, b)] if same else [(a, b), (b, a)]:
                others = y["clip_idx"].to_numpy()
                for i in x["clip_idx"].to_numpy():
                    rest = others[others != i]
                    values = sim[i // 3, rest // 3]
                    best = np.lexsort((rest, -np.round(values, 9)))[:5]
                    assert [o for o, _ in got[i]] == list(rest[best]) and np.allclose([s for _, s in got[i]], values[best], rtol=0, atol=1e-9)
        assert copies > 2 or per[60] <= 1.1 * per[1000] + 10


@pytest.mark.parametrize("d", [3, 12])
@pytest.mark.parametrize("norm", ["mean_length", "none"])
def test_cheaper_bounds_leave_what_the_full_one_leaves(monkeypatch, d, norm):
    rng = np.random.default_rng(d)
    walk = lambda at: at + np.cumsum(rng.normal(size=(int(rng.integers(1, 18)), d)), 0)
    a, b = ([walk(20 * rng.normal(size=d)) for _ in range(n)] for n in (90, 130))
    limit, others = rng.exponential(4, 90), rng.exponential(4, 130)
    limit[3], others[5] = np.inf, np.inf
    mine, theirs = dtw_.Bounds(a), dtw_.Bounds(b)
    want = mine.distances(theirs, norm) <= np.maximum(limit[:, None], others[None])
    asked, run = [], dtw_._balls
    monkeypatch.setattr(dtw_, "_balls", lambda *x: asked.append(len(x[2])) or run(*x))
    i, j = mine.within(theirs, limit, others, norm)
    got = np.zeros_like(want)
    got[i, j] = True
    assert len(i) == got.sum() and (got == want).all() and want.sum() < want.size / 2
    assert sum(asked) < want.size / 2


def test_pruning_is_the_report_of_the_pruned_table(spark, monkeypatch):
    _, df = walks(spark)
    want = pruned.dtw_topk_pruned(df, 4, n_cells=9, rows=16)[1].first()
    monkeypatch.setattr(pruned, "_meet", None)  # no distances of clips of two blocks
    got = pruned.pruning(df, 4, n_cells=9, rows=16).first()
    assert got == want and got.clip_pairs_within < got.clip_pairs
    assert pruned.pruning(df.limit(1), 4).first().clip_pairs == 0 and pruned.pruning(df.limit(0), 4).first().clip_pairs == 0


@pytest.mark.parametrize("queries", [3, 150])
def test_queries_are_scored_in_single_precision(monkeypatch, queries):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    f = [rng.normal(size=(int(rng.integers(2, 9)), 4)) for _ in range(900)]
    f[0], f[700] = f[600].copy(), f[600].copy()  # ties
    t = pa.table({"clip_idx": np.arange(900), "frames": [x.tolist() for x in f]})
    sim = -dtw_.cross(f, f)
    computed, run = [], dtw_.distances
    monkeypatch.setattr(dtw_, "distances", lambda *a: computed.append(len(a[2][0])) or run(*a))
    monkeypatch.setattr(dtw_, "cross", lambda *a: pytest.fail("all pairs in double precision"))
    got = {}
    for r in topk.nearest(t.slice(0, queries), t, False, 5, both=False).to_pylist():  # queries are in the corpus
        got.setdefault(r["clip_idx"], []).append(r["neighbor_idx"])
    ids = np.arange(900)
    assert got == {i: list((rest := ids[ids != i])[np.lexsort((rest, -np.round(sim[i, rest], 9)))][:5]) for i in range(queries)}
    assert sum(computed) < queries * 900 / 4


def test_a_query_is_sent_once_to_a_group_of_cells(spark, monkeypatch):
    sizes = {0: 10, 1: 25, 2: 0, 3: 70, 4: 5, 5: 5, 7: 31}
    first, number = cells.grouped(sizes, 8, 30)
    assert first.tolist() == [0, 1, 1, 2, 5, 5, 5, 6] and number.tolist() == [1, 1, 1, 3, 1, 1, 1, 2]
    rng = np.random.default_rng(7)
    z = rng.normal(size=(500, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "clip_idx long, z array<double>")
    want = sorted(tuple(r)[:3] for r in topk.cosine_topk(df, 3).collect())
    met, run = [], cells.best
    monkeypatch.setattr(cells, "best", lambda edges, k: met.append(edges) or run(edges, k))
    got = cells.cell_topk(df, 3, n_cells=40, probes=40, rows=130)
    assert sorted(tuple(r)[:3] for r in got.collect()) == want
    # 3 edges at most of a row for each group of cells, not for each of the 40.
    assert met[-1].count() <= 500 * 3 * 8


def test_cells_that_queries_ask_for():
    rng = np.random.default_rng(8)
    x, y, cell = rng.normal(size=(30, 4)), rng.normal(size=(50, 4)), np.sort(rng.integers(0, 6, 50))
    asks = rng.random((30, 6)) < 0.4
    qi, ci = np.arange(30), np.arange(20, 70)
    sim = np.where(asks[:, cell] & (qi[:, None] != ci[None]), x @ y.T, -np.inf)
    want = {int(i): [int(ci[j]) for j in np.lexsort((ci, -np.round(sim[i], 9)))[:4] if sim[i, j] > -np.inf] for i in qi}
    got = {}
    for r in cells._scored(qi, x, asks, ci, y, cell, 4).to_pylist():
        got.setdefault(r["clip_idx"], []).append(r["neighbor_idx"])
    assert got == {i: v for i, v in want.items() if v}


@pytest.mark.parametrize("groups", [1, 2])
def test_blocks_that_bounds_do_not_part_are_scored_in_single_precision(monkeypatch, groups):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    f = [rng.normal(size=(int(rng.integers(2, 9)), 4)) for _ in range(900)]
    ids, block = rng.permutation(900), np.arange(900) % 6
    met = {i: [j for j in range(i + 1, 6) if groups == 1 or (i < 3) != (j < 3)] for i in range(6)}
    sim = -dtw_.cross(f, f)
    meets = np.array([[j in met[i] or i in met[j] for j in range(6)] for i in range(6)])[block][:, block]
    assert (pruned._sides(meets) is None) == (groups == 1)
    # Limits as a block's own pairs give them.
    own = np.where((block[:, None] == block[None]) & ~np.eye(900, dtype=bool), sim, -np.inf)
    limit = -np.sort(own, axis=1)[:, -3]
    t = pa.table({"block": block, "clip_idx": ids, "frames": [x.tolist() for x in f], "limit": limit})
    monkeypatch.setattr(pruned, "TRIED", 64)
    monkeypatch.setattr(dtw_.Bounds, "within", lambda a, b, x, y, norm: np.nonzero(np.ones((len(x), len(y)), bool)))
    computed, run = [], dtw_.distances
    monkeypatch.setattr(dtw_, "distances", lambda *a: computed.append(len(a[2][0])) or run(*a))
    found = {}
    for r in pruned._meet(t, {i: j for i, j in met.items() if j}, 3, "symmetric2", "mean_length", False)[0].to_pylist():
        found.setdefault(r["clip_idx"], []).append(r["neighbor_idx"])
    # What is within the limit, of the three nearest in other blocks, is there, and nothing of blocks that do not meet.
    place = {int(x): n for n, x in enumerate(ids)}
    for n in range(900):
        near = [m for m in np.lexsort((ids, -np.round(np.where(meets[n], sim[n], -np.inf), 9)))[:3] if -sim[n, m] <= limit[n]]
        assert [int(ids[m]) for m in near] == found.get(int(ids[n]), [])[: len(near)]
        assert all(meets[n, place[x]] for x in found.get(int(ids[n]), []))
    assert sum(computed) < meets.sum() / 2 / 10
