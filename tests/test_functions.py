import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoframe.functions import arrays, dtw, pooling, transforms


def one(spark, column, **values):
    names = ", ".join(f"{k} {'array<array<double>>' if v and isinstance(v[0], (list, type(None))) else 'array<double>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def slow_dtw(a, b):
    r = {}
    for i in range(len(a)):
        for j in range(len(b)):
            d = math.dist(a[i], b[j])
            inf = math.inf
            least = min(r.get((i - 1, j - 1), inf) + d, r.get((i - 1, j), inf), r.get((i, j - 1), inf))
            r[i, j] = d if i == j == 0 else d + least
    return r[len(a) - 1, len(b) - 1] / ((len(a) + len(b)) / 2)


def clips(seed, n, t=7, d=3):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(rng.integers(1, t + 1), d)) for _ in range(n)]


def test_dtw_kernel_against_plain_recurrence():
    a, b = clips(0, 12), clips(1, 12)
    x, y = (i.ravel() for i in np.indices((12, 12)))
    got = dtw.distances(a, b, (x, y))
    assert np.allclose(got, [slow_dtw(a[i], b[j]) for i, j in zip(x, y)], atol=1e-12)


def test_dtw_is_symmetric_and_zero_on_itself():
    a = clips(2, 10)
    x, y = (i.ravel() for i in np.indices((10, 10)))
    d = dtw.distances(a, a, (x, y)).reshape(10, 10)
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0)


def test_dtw_norm_none_and_band():
    a, b = clips(3, 1, 5)[0], clips(4, 1, 5)[0]
    one_ = (np.array([0]), np.array([0]))
    assert np.isclose(dtw.distances([a], [b], one_, norm="none")[0], slow_dtw(a, b) * (len(a) + len(b)) / 2)
    wide = dtw.kernel(a[None], b[None], band=50)
    assert np.isclose(wide[0], dtw.kernel(a[None], b[None])[0])
    square = np.random.default_rng(0).normal(size=(2, 1, 4, 3))
    assert np.isclose(dtw.kernel(square[0], square[1], band=0.5)[0], sum(math.dist(*p) * (1 if i == 0 else 2) for i, p in enumerate(zip(square[0][0], square[1][0]))))


def test_dtw_rejects_empty_clips_and_unknown_names():
    with pytest.raises(ValueError):
        dtw.kernel(np.zeros((1, 0, 2)), np.zeros((1, 3, 2)))
    with pytest.raises(ValueError, match="is not one of"):
        dtw.distances([np.zeros((1, 1))], [np.zeros((1, 1))], (np.array([0]), np.array([0])), method="other")
    with pytest.raises(ValueError):
        transforms.design("other")


def test_dtw_column_equals_kernel(spark):
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(clips(5, 8), clips(6, 8)))]
    df = spark.createDataFrame(rows, "i int, a array<array<double>>, b array<array<double>>").repartition(2)
    got = {r.i: r.d for r in df.select("i", dtw.dtw_column(F.col("a"), F.col("b"), F.size("a"), F.size("b")).alias("d")).collect()}
    assert all(math.isclose(got[i], slow_dtw(a, b)) for i, a, b in rows)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=2, max_size=2), min_size=1, max_size=6), st.lists(st.lists(st.floats(-5, 5), min_size=2, max_size=2), min_size=1, max_size=6))
def test_dtw_property(a, b):
    got = dtw.distances([np.array(a)], [np.array(b)], (np.array([0]), np.array([0])))[0]
    assert math.isclose(got, slow_dtw(a, b), abs_tol=1e-9)


def test_stats4_known_values(spark):
    got = one(spark, pooling.pool(F.col("f"), "stats4"), f=[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 0.0]])
    assert np.allclose(got, [1.5, 0, math.sqrt(1.25), 0, 0, 0, 3, 0])


def test_keyframes8_short_clip_repeats(spark):
    assert one(spark, pooling.pool(F.col("f"), "keyframes8"), f=[[1.0], [2.0], [3.0], [4.0]]) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_flat_full_pads_with_zeros(spark):
    assert one(spark, pooling.pool(F.col("f"), "flat_full", 3, 2), f=[[1.0, 2.0], [3.0, 4.0]]) == [1, 2, 3, 4, 0, 0]


def test_pooling_validation(spark):
    with pytest.raises(ValueError):
        pooling.pool(F.col("f"), "other")
    with pytest.raises(ValueError):
        pooling.pool(F.col("f"), "flat_full")
    with pytest.raises(Exception, match="clip length"):
        one(spark, pooling.pool(F.col("f"), "flat_full", 1, 1), f=[[1.0], [2.0]])


FILL = [None, [1.0], None, None, [4.0], None]


def test_gap_fill_forward_and_nearest(spark):
    assert one(spark, transforms.gap_fill(F.col("f"), 1), f=FILL) == [[1], [1], [1], [1], [4], [4]]
    assert one(spark, transforms.gap_fill(F.col("f"), 1, "nearest"), f=FILL) == [[1], [1], [1], [4], [4], [4]]
    tie = [[1.0], None, [3.0]]
    assert one(spark, transforms.gap_fill(F.col("f"), 1, "nearest"), f=tie) == [[1], [1], [3]]
    assert one(spark, transforms.gap_fill(F.col("f"), 2), f=[None, None]) == [[0, 0], [0, 0]]
    with pytest.raises(ValueError):
        transforms.gap_fill(F.col("f"), 1, "other")


@pytest.mark.parametrize(("n", "first", "last"), [(12, 0, 11), (20, 0, 19), (21, 0, 19), (30, 5, 24)])
def test_centre_crop(spark, n, first, last):
    got = one(spark, transforms.centre_crop(F.col("f"), 40, 1), f=[[float(i)] for i in range(n)])
    assert (got[0][0], got[-1][0]) == (first, last)


def test_joint_pairs_structure():
    pairs = transforms.joint_pairs()
    assert len(pairs) == len(set(pairs)) == 160
    assert all(a < 21 <= b for a, b in pairs[:40]) and all(b < 21 for _, b in pairs[40:100]) and all(a >= 21 for a, _ in pairs[100:])
    assert not {20, 41} & {j for p in pairs for j in p}


def test_interjoint_values(spark):
    frame = np.random.default_rng(0).normal(size=126)
    got = one(spark, transforms.interjoint(F.col("f"), 126), f=[frame.tolist()])[0]
    joints = frame.reshape(42, 3)
    assert np.allclose(got, [np.linalg.norm(joints[a] - joints[b]) for a, b in transforms.joint_pairs()])
    with pytest.raises(ValueError):
        transforms.interjoint(F.col("f"), 84)


def test_joint_layout():
    assert transforms.joint_layout(126) == (21, 3) and transforms.joint_layout(42) == (7, 3) and transforms.joint_layout(28) == (7, 2)
    with pytest.raises(ValueError):
        transforms.joint_layout(100)


def test_pad_and_truncate(spark):
    assert one(spark, transforms.pad_to(F.col("f"), F.lit(4)), f=[[1.0], [2.0]]) == [[1], [2], [2], [2]]
    assert one(spark, transforms.truncate(F.col("f"), 1), f=[[1.0], [2.0]]) == [[1]]


def test_vectors(spark):
    v = [3.0, 4.0]
    assert one(spark, arrays.norm(F.col("v")), v=v) == 5
    assert np.allclose(one(spark, arrays.l2_normalize(F.col("v")), v=v), [0.6, 0.8])
    assert one(spark, arrays.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0, 0]
    x = one(spark, F.transform("v", arrays.softplus), v=[-800.0, 0.0, 800.0])
    assert np.allclose(x, [0, math.log(2), 800])


def test_positional_encoding(spark):
    got = spark.range(1).select(arrays.positional_encoding(F.lit(3), 5).alias("p")).first().p
    want = [[f(p * 10000 ** (-2 * (k // 2) / 5)) for k, f in enumerate([math.sin, math.cos, math.sin, math.cos, math.sin])] for p in range(3)]
    assert np.allclose(got, want)


def plain_cost(a, b):
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    r = np.full((len(a) + 1, len(b) + 1), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            r[i + 1, j + 1] = d[i, j] if i == j == 0 else d[i, j] + min(r[i, j] + d[i, j], r[i, j + 1], r[i + 1, j])
    return r[-1, -1]


@pytest.mark.parametrize("width", [1, 4, 7, 8, 12])
def test_kernels_of_few_and_many_dimensions(width):
    rng = np.random.default_rng(width)
    clips = [rng.normal(size=(n, width)) for n in (1, 2, 5, 5, 9, 1, 7)]
    pairs = np.divmod(np.arange(49), 7)
    want = np.array([plain_cost(clips[i], clips[j]) for i, j in zip(*pairs, strict=True)])
    assert np.allclose(dtw.distances(clips, clips, pairs, norm="none"), want, rtol=0, atol=1e-12)
    near, room = dtw.quick(clips, clips, "none")
    assert (np.abs(near.reshape(-1) - want) <= room).all()


def test_kernels_are_fast():
    """The unit is the time of the plainest passes over as many cells."""
    rng = np.random.default_rng(0)
    clips = list(rng.normal(size=(900, 10, 4)))
    pairs = rng.integers(0, 900, (2, 20_000))
    cells = rng.random((100, 20_000))

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    out = np.empty_like(cells)
    unit = least(lambda: [np.multiply(cells, cells, out=out) for _ in range(10)])
    double, single = least(lambda: dtw.distances(clips, clips, pairs)), least(lambda: dtw.quick(clips[:450], clips))
    print(double / unit, single / unit)
    assert double < 5 * unit
