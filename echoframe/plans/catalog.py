"""Registered queries and the SQL that says the same."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, dtw, pooling, transforms
from ..operators import cells, losses, metrics, mining, model, observed, pruned, sampler, topk
from ..scratch import written
from ..sources import clips as src

ROOT = str(Path(__file__).resolve().parents[2])
QUERIES, SQL = {}, {}
K, RELEVANCE, SEED = 20, 20, 7


def query(sql: str | None = None):
    def register(f):
        def run(spark, sf_dir):
            env = spark.sparkContext.environment
            if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
                env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c, digits: int = 6):
    return F.round(c, digits) + 0.0


# Common parts of the SQL.
CLIPS = """clips AS (SELECT vec_id AS clip_idx, label AS video_number, embedding::DOUBLE[] AS z, (4 + vec_id % 13)::INT AS len,
  list_transform(range(4 + vec_id % 13), lambda t: (embedding::DOUBLE[])[4*t+1 : 4*t+4]) AS frames FROM embeddings)"""


def sql_dtw(pairs: str) -> str:
    """CTEs from `pairs`(i, j, la, lb, fa, fb) to dtw(i, j, sim)."""
    return f"""pairs AS ({pairs}),
costs AS (SELECT i, j, la, lb, list_transform(fa, lambda x: list_transform(fb, lambda y: list_distance(x, y))) AS d FROM pairs),
lasts AS (SELECT i, j, la, lb, list_reduce(d, lambda acc, row: list_reduce(list_transform(range(1, lb + 1), lambda k:
   [row[k], CASE WHEN len(acc) = 0 THEN CASE WHEN k = 1 THEN 0.0 ELSE 1e300 END ELSE least(acc[k], CASE WHEN k = 1 THEN 1e300 ELSE acc[k-1] + row[k] END) END]),
   lambda r, e: list_append(r, CASE WHEN len(r) = 0 THEN e[1] + e[2] ELSE e[1] + least(e[2], r[len(r)]) END), []::DOUBLE[]), []::DOUBLE[]) AS last FROM costs),
dtw AS (SELECT i, j, -(last[lb] / ((la + lb) / 2.0)) AS sim FROM lasts)"""


ALL_PAIRS = "SELECT a.clip_idx i, b.clip_idx j, a.len la, b.len lb, a.frames fa, b.frames fb FROM clips a JOIN clips b ON a.clip_idx < b.clip_idx"


def sql_top(name: str, source: str, k: int, i: str = "i", j: str = "j") -> str:
    return f"{name} AS (SELECT * FROM (SELECT {i} AS clip_idx, row_number() OVER (PARTITION BY {i} ORDER BY round(sim, 9) DESC, {j})::INT AS rank, {j} AS neighbor_idx, sim FROM {source}) WHERE rank <= {k})"


def sql_dtw_edges(k: int, pairs: str = ALL_PAIRS, name: str = "target") -> str:
    return f"{sql_dtw(pairs)}, both_ways AS (SELECT i, j, sim FROM dtw UNION ALL SELECT j, i, sim FROM dtw), {sql_top(name, 'both_ways', k)}"


def sql_cosine_edges(k: int, name: str = "model") -> str:
    return f"cosine AS (SELECT a.clip_idx i, b.clip_idx j, list_dot_product(a.z, b.z) AS sim FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx), {sql_top(name, 'cosine', k)}"


def split_sql() -> str:
    return f"""held AS (SELECT clip_idx FROM clips ORDER BY md5('{SEED}-' || clip_idx::VARCHAR), clip_idx LIMIT (SELECT round_even(0.1 * count(*), 0)::BIGINT FROM clips)),
train AS (SELECT clip_idx FROM clips WHERE clip_idx NOT IN (SELECT clip_idx FROM held))"""


# Sources and filters.


@query("SELECT vec_id AS clip_idx, label AS video_number FROM embeddings WHERE label IN (SELECT DISTINCT label FROM embeddings ORDER BY label LIMIT 3)")
def first_videos(spark, d):
    rows = src.embedding_clips(spark, d).withColumn("node_number", F.col("clip_idx"))
    return src.first_videos(rows, 3).select("clip_idx", "video_number")


_EVENTS = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame, value::DOUBLE AS v, (props::JSON->>'$.k')::DOUBLE AS k, event_type FROM events),
h AS (SELECT user_id, frame, CASE WHEN event_type NOT IN ('error', 'view') THEN [v, k, frame::DOUBLE] END AS l, CASE WHEN event_type <> 'signup' THEN [k, v, -frame::DOUBLE] END AS r FROM e)"""
_HANDS = ", ".join(f"round(coalesce({s}[{i + 1}], 0.0), 6) + 0.0 AS {s}{i}" for s in "lr" for i in range(3))


def _event_rows(spark, d, fill):
    t = src.trajectories(src.event_recordings(spark, d), fill, joints=1)
    x = t.select(F.col("node_number").cast("long").alias("clip_idx"), F.posexplode("frames").alias("frame", "f"))
    return x.select("clip_idx", F.col("frame").cast("long").alias("frame"), *(r(F.get("f", F.lit(3 * s + i))).alias(f"{'lr'[s]}{i}") for s in range(2) for i in range(3)))


def _fill_sql(side):
    w = "(PARTITION BY user_id ORDER BY frame"
    return f"coalesce(last_value({side} IGNORE NULLS) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({side} IGNORE NULLS) OVER {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {side}"


@query(f"WITH {_EVENTS}, f AS (SELECT user_id, frame, {_fill_sql('l')}, {_fill_sql('r')} FROM h) SELECT user_id AS clip_idx, frame, {_HANDS} FROM f WHERE frame < 42")
def gap_fill_forward(spark, d):
    return _event_rows(spark, d, "ffill")


def _near_sql(side):
    w = "(PARTITION BY user_id ORDER BY frame"
    at = f"CASE WHEN {side} IS NOT NULL THEN frame END"
    return f"max({at}) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {side}b, min({at}) OVER {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {side}a"


def _pick_sql(s):
    return f"CASE WHEN {s}b IS NULL THEN {s}a WHEN {s}a IS NULL THEN {s}b WHEN {s}a - frame < frame - {s}b THEN {s}a ELSE {s}b END"


@query(f"""WITH {_EVENTS}, n AS (SELECT user_id, frame, {_near_sql('l')}, {_near_sql('r')} FROM h),
f AS (SELECT n.user_id, n.frame, x.l, y.r FROM n LEFT JOIN h x ON x.user_id = n.user_id AND x.frame = {_pick_sql('l').replace('frame', 'n.frame')} LEFT JOIN h y ON y.user_id = n.user_id AND y.frame = {_pick_sql('r').replace('frame', 'n.frame')})
SELECT user_id AS clip_idx, frame, {_HANDS} FROM f WHERE frame < 42""")
def gap_fill_nearest(spark, d):
    return _event_rows(spark, d, "nearest")


_LINES = """li AS (SELECT l_orderkey AS clip_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS n,
  count(*) OVER (PARTITION BY l_orderkey) AS length, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE / 1000 AS p FROM lineitem)"""


@query("SELECT l_orderkey AS clip_idx, count(*)::INT AS length FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def min_frames(spark, d):
    return src.order_clips(spark, d).where(F.col("length") >= transforms.MIN_FRAMES).select("clip_idx", "length")


@query(f"WITH {_LINES}, w AS (SELECT max(length) AS m FROM li) SELECT clip_idx, (SELECT m FROM w)::INT AS padded, round(sum(q) + max(CASE WHEN n = length THEN q END) * ((SELECT m FROM w) - max(length)), 6) AS sum_q FROM li GROUP BY clip_idx")
def pad_last_frame(spark, d):
    c = src.order_clips(spark, d)
    c = c.crossJoin(c.agg(F.max("length").alias("m")))  # one row
    padded = transforms.pad_to(F.col("frames"), F.col("m"))
    return c.select("clip_idx", F.size(padded).alias("padded"), r(arrays.total(F.transform(padded, lambda f: F.get(f, F.lit(0))))).alias("sum_q"))


@query(f"""WITH {_LINES}, c AS (SELECT *, greatest(length - 4, 0) AS extra FROM li)
SELECT clip_idx, count(*)::INT AS kept, round(min_by(q, n), 6) AS first_q, round(max_by(q, n), 6) AS last_q FROM c WHERE n > extra // 2 AND n <= extra // 2 + 4 GROUP BY clip_idx""")
def tubelet_crop(spark, d):
    c = src.order_clips(spark, d).withColumn("kept", transforms.centre_crop(F.col("frames"), 8, 1))
    return c.select("clip_idx", F.size("kept").alias("kept"), r(F.element_at("kept", 1)[0]).alias("first_q"), r(F.element_at("kept", -1)[0]).alias("last_q"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS clip_idx, o_orderkey IN (SELECT l_orderkey FROM f) AS has_feature FROM orders""")
def feature_availability(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_idx"))
    f = src.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("clip_idx"))
    semi, anti = o.join(f, "clip_idx", "left_semi"), o.join(f, "clip_idx", "left_anti")
    return semi.withColumn("has_feature", F.lit(True)).unionByName(anti.withColumn("has_feature", F.lit(False)))


# Projections.


def _long(df, array, pos="pos"):
    return df.select("clip_idx", F.posexplode(array).alias(pos, "value")).withColumn("value", r("value"))


def _unnest(expr):
    return f"WITH {CLIPS}, v AS (SELECT clip_idx, {expr} AS v FROM clips) SELECT clip_idx, (i - 1)::INT AS pos, round(v[i], 6) + 0.0 AS value FROM (SELECT clip_idx, v, unnest(range(1, len(v) + 1)) AS i FROM v)"


_COLUMN = "list_transform(range(1, 5), lambda k: {})"
_MEAN = _COLUMN.format("list_avg(list_transform(frames, lambda f: f[k]))")
_STD = _COLUMN.format("sqrt(greatest(list_avg(list_transform(frames, lambda f: f[k] * f[k])) - pow(list_avg(list_transform(frames, lambda f: f[k])), 2), 0.0))")


@query(_unnest("list_transform(list_transform(z, lambda x: x * 3 + 1), lambda x: x / greatest(sqrt(list_sum(list_transform(z, lambda y: (y * 3 + 1) * (y * 3 + 1)))), 1e-12))"))
def l2_normalize(spark, d):
    c = src.embedding_clips(spark, d)
    return _long(c, arrays.l2_normalize(F.transform("z", lambda x: x * 3 + 1)))


@query(_unnest(_MEAN))
def mean_pool(spark, d):
    return _long(src.embedding_clips(spark, d), arrays.mean_rows(F.col("frames")))


@query(_unnest(f"list_transform({_MEAN}, lambda x: x / greatest(sqrt(list_sum(list_transform({_MEAN}, lambda y: y * y))), 1e-12))"))
def masked_mean_pool(spark, d):
    """Full-width frames with a mask: the valid prefix is pooled and normalised."""
    c = src.embedding_clips(spark, d).withColumn("all", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("z", 4 * t + 1, F.lit(4))))
    return _long(c, arrays.l2_normalize(arrays.mean_rows(F.slice("all", 1, F.col("length")))))


@query(_unnest(f"list_concat({_MEAN}, {_STD}, frames[1], frames[len(frames)])"))
def pool_stats4(spark, d):
    return _long(src.embedding_clips(spark, d), pooling.pool(F.col("frames"), "stats4"))


@query(_unnest("flatten(list_transform(range(0, 8), lambda k: frames[1 + round(k / 7.0 * (len - 1))::INT]))"))
def pool_keyframes8(spark, d):
    return _long(src.embedding_clips(spark, d), pooling.pool(F.col("frames"), "keyframes8"))


@query(_unnest("list_resize(flatten(frames), 64, 0.0)"))
def pool_flat_full(spark, d):
    return _long(src.embedding_clips(spark, d), pooling.pool(F.col("frames"), "flat_full", 16, 4))


_PAIRS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(transforms.joint_pairs()))


@query(f"""WITH p(pair, a, b) AS (VALUES {_PAIRS}),
f AS (SELECT x.vec_id // 2 AS f, list_concat((x.embedding::DOUBLE[])[1:63], (y.embedding::DOUBLE[])[1:63]) AS v FROM embeddings x JOIN embeddings y ON x.vec_id % 2 = 0 AND y.vec_id = x.vec_id + 1),
n AS (SELECT f // 10 AS clip_idx, row_number() OVER (PARTITION BY f // 10 ORDER BY f) - 1 AS frame, v FROM f)
SELECT clip_idx, frame::INT AS frame, pair::INT AS pair, round(sqrt(pow(v[3*a+1] - v[3*b+1], 2) + pow(v[3*a+2] - v[3*b+2], 2) + pow(v[3*a+3] - v[3*b+3], 2)), 6) AS dist FROM n, p""")
def interjoint_distances(spark, d):
    c = src.two_hand_clips(spark, d).select("clip_idx", F.posexplode(transforms.interjoint(F.col("frames"), 126)).alias("frame", "x"))
    return c.select("clip_idx", "frame", F.posexplode("x").alias("pair", "dist")).withColumn("dist", r("dist"))


@query(f"""WITH {CLIPS}, t AS (SELECT clip_idx, unnest(range(len)) AS t FROM clips), k AS (SELECT unnest(range(5)) AS k)
SELECT clip_idx, t::INT AS t, k::INT AS pos, round(CASE WHEN k % 2 = 0 THEN sin(t * pow(10000.0, -2.0 * (k // 2) / 5)) ELSE cos(t * pow(10000.0, -2.0 * (k // 2) / 5)) END, 6) + 0.0 AS value FROM t, k""")
def positional_encoding(spark, d):
    c = src.embedding_clips(spark, d).select("clip_idx", F.posexplode(arrays.positional_encoding(F.col("length"), 5)).alias("t", "x"))
    return c.select("clip_idx", "t", F.posexplode("x").alias("pos", "value")).withColumn("value", r("value"))


@query(f"WITH {CLIPS}, f AS (SELECT unnest(frames) AS f FROM clips), k AS (SELECT unnest(range(4)) AS k) SELECT k::INT AS pos, round(avg(f[k+1]), 6) + 0.0 AS value FROM f, k GROUP BY k")
def query_grand_mean(spark, d):
    return model.grand_mean(src.embedding_clips(spark, d)).select("pos", r("value").alias("value"))


@query(f"""WITH {CLIPS}, m AS (SELECT max(len) AS m FROM clips), f AS (SELECT unnest(flatten(list_concat(frames, list_transform(range(m - len), lambda i: frames[len])))) AS x FROM clips, m)
SELECT (SELECT count(DISTINCT len) FROM clips) AS lengths, (SELECT m FROM m)::INT AS longest, round(greatest(stddev_samp(x), 1e-6), 6) AS std FROM f""")
def trajectory_statistics(spark, d):
    """Distinct lengths, the greatest, and the deviation of all numbers of the padded clips."""
    c = src.embedding_clips(spark, d)
    c = c.crossJoin(c.agg(F.max("length").alias("m"), F.countDistinct("length").alias("lengths")))  # one row
    x = c.select("lengths", "m", F.explode(F.flatten(transforms.pad_to(F.col("frames"), F.col("m")))).alias("x"))
    return x.groupBy("lengths", F.col("m").alias("longest")).agg(r(F.greatest(F.stddev_samp("x"), F.lit(1e-6))).alias("std"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS distinct_ids, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings")
def contiguity(spark, d):
    c = src.embedding_clips(spark, d)
    metrics.check_contiguous(c)
    return c.agg(F.count("*").alias("n"), F.countDistinct("clip_idx").alias("distinct_ids"), F.min("clip_idx").alias("first_id"), F.max("clip_idx").alias("last_id"))


# Neighbours.


def _edges(df, sim="dtw_sim"):
    return df.select("clip_idx", "rank", "neighbor_idx", r(sim).alias(sim))


@query(f"WITH {CLIPS}, {sql_dtw_edges(K)} SELECT clip_idx, rank, neighbor_idx, round(sim, 6) + 0.0 AS dtw_sim FROM target")
def dtw_topk(spark, d):
    return _edges(topk.dtw_topk(src.embedding_clips(spark, d), K))


@query(SQL["dtw_topk"])
def dtw_topk_pruned(spark, d):
    """The same by blocks of like clips, thresholds and lower bounds."""
    return _edges(pruned.dtw_topk_pruned(src.embedding_clips(spark, d), K, counted=False)[0])


@query()
def dtw_pruning(spark, d):
    """What blocks, thresholds and bounds leave to compute, over clips in groups: each event user's windows of 16 values in order."""
    return pruned.pruning(_walks(spark, d), 5)


def _walks(spark, d):
    """Clips of three dimensions: windows of 16 events of a user, with the running sum of values, the value and the user's level."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value")
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumns({"n": F.row_number().over(order) - 1, "total": F.sum("value").over(order)})
    frame = F.struct("n", F.array(F.col("total") / 10.0, F.col("value") / 100.0, (F.col("user_id") % 7) * 50.0).alias("x"))
    c = e.groupBy("user_id", F.expr("n div 16").alias("w")).agg(F.sort_array(F.collect_list(frame)).alias("f"))
    return c.select((F.col("user_id") * 1000 + F.col("w")).alias("clip_idx"), F.transform("f", lambda x: x["x"]).alias("frames"))


_BATCH_PAIRS = ALL_PAIRS + " AND a.clip_idx // 25 = b.clip_idx // 25"


def _batch_pairs(c, size=25):
    a = c.select((F.expr(f"clip_idx div {size}")).alias("batch"), F.col("clip_idx").alias("i"), F.col("frames").alias("fa"), F.col("length").alias("la"), F.col("z").alias("za"))
    b = a.withColumnsRenamed({"i": "j", "fa": "fb", "la": "lb", "za": "zb"})
    return a.join(b, "batch")


@query(f"WITH {CLIPS}, {sql_dtw(_BATCH_PAIRS)} SELECT i, j, round(sim, 6) + 0.0 AS sim FROM dtw")
def dtw_batch_native(spark, d):
    """Pairs within batches of 25 clips by higher-order functions alone."""
    p = _batch_pairs(src.embedding_clips(spark, d)).where("i < j")
    return p.select("i", "j", r(-dtw.dtw_column(F.col("fa"), F.col("fb"), F.col("la"), F.col("lb"))).alias("sim"))


@query(f"WITH {CLIPS}, {sql_dtw(_BATCH_PAIRS)} SELECT i AS clip_idx, j AS neighbor_idx, round(sim, 6) + 0.0 AS sim FROM dtw")
def dtw_batch_arrow(spark, d):
    c = src.embedding_clips(spark, d)
    p = _batch_pairs(c).where("i < j").select(F.col("i").alias("clip_idx"), F.col("j").alias("neighbor_idx"))
    return topk.dtw_pairs(p, c).select("clip_idx", "neighbor_idx", r("sim").alias("sim"))


@query(f"WITH {CLIPS}, {sql_cosine_edges(K)} SELECT clip_idx, rank, neighbor_idx, round(sim, 6) + 0.0 AS sim FROM model")
def cosine_topk(spark, d):
    return _edges(topk.cosine_topk(src.embedding_clips(spark, d), K), "sim")


@query(SQL["cosine_topk"])
def cosine_cells(spark, d):
    """The same through the inverted file, with every cell probed."""
    return _edges(cells.cell_topk(src.embedding_clips(spark, d).select("clip_idx", "z"), K, probes=1 << 30), "sim")


@query()
def cell_recall(spark, d):
    """How many of the 20 nearest the inverted file finds with the probes that it chooses for a recall of 0.97."""
    v = src.embedding_clips(spark, d).select("clip_idx", "z")
    s = topk.sanity_check(cells.cell_topk(v, K), topk.cosine_topk(v, K), K)
    return s.select(*(r(x).alias(x) for x in ("mean", "min", "max")))


_POOLED = f"""pooled AS (SELECT clip_idx, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS z FROM (SELECT clip_idx, list_concat({_MEAN}, {_STD}, frames[1], frames[len]) AS v FROM clips)),
near AS (SELECT a.clip_idx i, b.clip_idx j, list_dot_product(a.z, b.z) AS sim FROM pooled a JOIN pooled b ON a.clip_idx <> b.clip_idx), {sql_top('chosen', 'near', 50)}"""
_REFINE = "SELECT a.clip_idx i, b.clip_idx j, a.len la, b.len lb, a.frames fa, b.frames fb FROM chosen x JOIN clips a ON a.clip_idx = x.clip_idx JOIN clips b ON b.clip_idx = x.neighbor_idx"
_FILTERED = f"{_POOLED}, {sql_dtw(_REFINE)}, {sql_top('refined', 'dtw', K)}"


@query(f"WITH {CLIPS}, {_FILTERED} SELECT clip_idx, rank, neighbor_idx, round(sim, 6) + 0.0 AS dtw_sim FROM refined")
def dtw_filter_and_refine(spark, d):
    return _edges(topk.filtered_topk(src.embedding_clips(spark, d), K, 50))


@query()
def dtw_cells_and_refine(spark, d):
    """Filter and refine with candidates from the inverted file."""
    return _edges(topk.filtered_topk(src.embedding_clips(spark, d), K, 50, index="cells"))


@query(f"""WITH {CLIPS}, {_FILTERED}, exact_pairs AS ({ALL_PAIRS}), {sql_dtw_edges(K, name='exact').replace('pairs AS (', 'pairs2 AS (', 1).replace('FROM pairs)', 'FROM pairs2)').replace('costs AS', 'costs2 AS').replace('FROM costs)', 'FROM costs2)').replace('lasts AS', 'lasts2 AS').replace('FROM lasts)', 'FROM lasts2)').replace('dtw AS', 'dtw2 AS').replace('FROM dtw', 'FROM dtw2')},
per AS (SELECT e.clip_idx, count(f.clip_idx) / count(*) AS recall FROM exact e LEFT JOIN refined f ON e.clip_idx = f.clip_idx AND e.neighbor_idx = f.neighbor_idx GROUP BY 1)
SELECT round(avg(recall), 6) AS mean, round(min(recall), 6) AS min, round(max(recall), 6) AS max FROM per""")
def filter_recall(spark, d):
    """How many of the exact neighbours filter and refine finds."""
    c = src.embedding_clips(spark, d)
    s = topk.sanity_check(topk.filtered_topk(c, K, 50), topk.dtw_topk(c, K), K)
    return s.select(*(r(x).alias(x) for x in ("mean", "min", "max")))


def _split(spark, d):
    c = src.embedding_clips(spark, d)
    return c, *sampler.split(c, 0.1, SEED)


_TRAIN_PAIRS = ALL_PAIRS + " WHERE a.clip_idx IN (SELECT clip_idx FROM train) AND b.clip_idx IN (SELECT clip_idx FROM train)"
_HELD_PAIRS = "SELECT a.clip_idx i, b.clip_idx j, a.len la, b.len lb, a.frames fa, b.frames fb FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx WHERE a.clip_idx IN (SELECT clip_idx FROM held) AND b.clip_idx IN (SELECT clip_idx FROM train)"


@query(f"WITH {CLIPS}, {split_sql()} SELECT clip_idx, clip_idx IN (SELECT clip_idx FROM held) AS held_out FROM clips")
def holdout_split(spark, d):
    _, train, held = _split(spark, d)
    return train.select("clip_idx", F.lit(False).alias("held_out")).unionByName(held.select("clip_idx", F.lit(True).alias("held_out")))


@query(f"SELECT vec_id AS clip_idx FROM embeddings ORDER BY md5('{SEED}-' || vec_id::VARCHAR), vec_id LIMIT 100")
def clip_sample(spark, d):
    return sampler.sample(src.embedding_clips(spark, d), 100, SEED).select("clip_idx")


@query(f"WITH {CLIPS}, {split_sql()}, {sql_dtw_edges(K, _TRAIN_PAIRS)} SELECT clip_idx, rank, neighbor_idx, round(sim, 6) + 0.0 AS dtw_sim FROM target")
def train_pool_topk(spark, d):
    c, train, _ = _split(spark, d)
    return _edges(topk.train_pool(c, train, K))


@query(f"WITH {CLIPS}, {split_sql()}, {sql_dtw(_HELD_PAIRS)}, {sql_top('target', 'dtw', K)} SELECT clip_idx, rank, neighbor_idx, round(sim, 6) + 0.0 AS dtw_sim FROM target")
def query_corpus_topk(spark, d):
    _, train, held = _split(spark, d)
    return _edges(topk.dtw_against(held, train, K))


# Metrics.

_RECALL = """hits AS (SELECT m.clip_idx, min(m.rank) AS best FROM model m JOIN target t ON m.clip_idx = t.clip_idx AND m.neighbor_idx = t.neighbor_idx WHERE t.rank <= 20 GROUP BY 1)
SELECT k::INT AS k, round(avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM {} q LEFT JOIN hits USING (clip_idx), (VALUES (1), (5), (10), (20)) ks(k) GROUP BY k"""


def _recall(df):
    return df.select("k", r("recall").alias("recall"))


@query(f"WITH {CLIPS}, {sql_cosine_edges(K)}, {sql_dtw_edges(K)}, " + _RECALL.format("clips"))
def recall_at_k(spark, d):
    c = src.embedding_clips(spark, d)
    return _recall(metrics.recall_at(topk.cosine_topk(c, K), topk.dtw_topk(c, K), c, [1, 5, 10, 20], RELEVANCE))


@query(f"WITH {CLIPS}, {split_sql()}, cosine AS (SELECT a.clip_idx i, b.clip_idx j, list_dot_product(a.z, b.z) AS sim FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx WHERE a.clip_idx IN (SELECT clip_idx FROM train) AND b.clip_idx IN (SELECT clip_idx FROM train)), {sql_top('model', 'cosine', K)}, {sql_dtw_edges(K, _TRAIN_PAIRS)}, " + _RECALL.format("train"))
def train_pool_recall(spark, d):
    c, train, _ = _split(spark, d)
    return _recall(metrics.recall_at(topk.cosine_topk(train, K), topk.train_pool(c, train, K), train, [1, 5, 10, 20], RELEVANCE))


@query(f"WITH {CLIPS}, {sql_cosine_edges(10)}, {sql_dtw_edges(10)} SELECT round(count(*) / (10.0 * (SELECT count(*) FROM clips)), 6) AS mutual_knn FROM model m JOIN target t ON m.clip_idx = t.clip_idx AND m.neighbor_idx = t.neighbor_idx")
def mutual_knn(spark, d):
    c = src.embedding_clips(spark, d)
    return metrics.mutual_knn(topk.cosine_topk(c, 10), topk.dtw_topk(c, 10), 10, c.count()).select(r("mutual_knn").alias("mutual_knn"))


def _hsic_sql(k, l, out):
    return f"""{out} AS (SELECT ((SELECT coalesce(sum(a.x * b.x), 0) FROM {k} a JOIN {l} b ON a.i = b.j AND a.j = b.i) + (SELECT sum(x) FROM {k}) * (SELECT sum(x) FROM {l}) / ((m - 1.0) * (m - 2.0))
 - 2.0 / (m - 2.0) * (SELECT sum(c * r) FROM (SELECT j v, sum(x) c FROM {k} GROUP BY 1) JOIN (SELECT i v, sum(x) r FROM {l} GROUP BY 1) USING (v))) / (m * (m - 3.0)) AS h FROM (SELECT count(*)::DOUBLE AS m FROM clips))"""


_SIDES = """a AS (SELECT clip_idx i, neighbor_idx j, sim x FROM model), b AS (SELECT clip_idx i, neighbor_idx j, 1.0::DOUBLE x FROM target),
ai AS (SELECT a.* FROM a SEMI JOIN b USING (i, j)), bi AS (SELECT b.* FROM b SEMI JOIN a USING (i, j))"""


@query(f"""WITH {CLIPS}, {sql_cosine_edges(10)}, {sql_dtw_edges(10)}, {_SIDES}, {_hsic_sql('ai', 'bi', 'ab')}, {_hsic_sql('a', 'a', 'aa')}, {_hsic_sql('b', 'b', 'bb')}
SELECT round(CASE WHEN aa.h > 0 AND bb.h > 0 THEN ab.h / sqrt(aa.h * bb.h) ELSE 0 END, 6) AS cknna FROM ab, aa, bb""")
def cknna(spark, d):
    c = src.embedding_clips(spark, d)
    # Both tables (10 rows a clip) are read several times.
    return metrics.cknna(written(topk.cosine_topk(c, 10), "model"), written(topk.dtw_topk(c, 10), "target"), 10, c.count()).select(r("cknna").alias("cknna"))


def _centred_sql(x, y, out):
    return f"""{out} AS (SELECT (SELECT coalesce(sum(p.x * q.x), 0) FROM {x} p JOIN {y} q USING (i, j)) - (SELECT coalesce(sum(u * v), 0) FROM (SELECT i, sum(x) u FROM {x} GROUP BY 1) JOIN (SELECT i, sum(x) v FROM {y} GROUP BY 1) USING (i)) / nc
 - (SELECT coalesce(sum(u * v), 0) FROM (SELECT j, sum(x) u FROM {x} GROUP BY 1) JOIN (SELECT j, sum(x) v FROM {y} GROUP BY 1) USING (j)) / nr + (SELECT coalesce(sum(x), 0) FROM {x}) * (SELECT coalesce(sum(x), 0) FROM {y}) / (nr * nc) AS h FROM shape)"""


_HELD_COS = f"cosine AS (SELECT a.clip_idx i, b.clip_idx j, list_dot_product(a.z, b.z) AS sim FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx WHERE a.clip_idx IN (SELECT clip_idx FROM held)), {sql_top('model', 'cosine', 10)}"
_HELD_ALL = "SELECT a.clip_idx i, b.clip_idx j, a.len la, b.len lb, a.frames fa, b.frames fb FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx WHERE a.clip_idx IN (SELECT clip_idx FROM held)"


@query(f"""WITH {CLIPS}, {split_sql()}, {_HELD_COS}, {sql_dtw(_HELD_ALL)}, {sql_top('target', 'dtw', 10)}, {_SIDES},
shape AS (SELECT (SELECT count(*) FROM held)::DOUBLE AS nr, (SELECT count(*) FROM clips)::DOUBLE AS nc), {_centred_sql('ai', 'bi', 'ab')}, {_centred_sql('a', 'a', 'aa')}, {_centred_sql('b', 'b', 'bb')}
SELECT round(CASE WHEN aa.h > 0 AND bb.h > 0 THEN greatest(-1, least(1, ab.h / sqrt(aa.h * bb.h))) ELSE 0 END, 6) AS cknna FROM ab, aa, bb""")
def pool_cknna(spark, d):
    """Held-out queries against all clips."""
    c, _, held = _split(spark, d)
    edges = written(topk.cosine_against(held, c, 10), "model")
    return metrics.pool_cknna(edges, written(topk.dtw_against(held, c, 10), "target"), 10, held.count(), c.count()).select(r("cknna").alias("cknna"))


@query(f"WITH {CLIPS}, {sql_cosine_edges(5)}, {sql_dtw_edges(1)} SELECT round(avg(CASE WHEN m.clip_idx IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM target t LEFT JOIN model m ON m.clip_idx = t.clip_idx AND m.neighbor_idx = t.neighbor_idx")
def top1_recall(spark, d):
    c = src.embedding_clips(spark, d)
    return metrics.top1_recall(topk.cosine_topk(c, 5), topk.dtw_topk(c, 1), 5).select(r("recall").alias("recall"))


@query(f"WITH {CLIPS}, k AS (SELECT unnest(range(1, 65)) AS k) SELECT round(avg(s), 6) AS z_std FROM (SELECT k, stddev_samp(z[k]) AS s FROM clips, k GROUP BY k)")
def z_std(spark, d):
    return metrics.z_std(src.embedding_clips(spark, d)).select(r("z_std").alias("z_std"))


@query(f"WITH {CLIPS}, s AS (SELECT list_dot_product(a.z, b.z) AS x FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx) SELECT round(avg(x), 6) + 0.0 AS off_diag_mean, round(stddev_samp(x), 6) AS off_diag_std FROM s")
def off_diagonal(spark, d):
    o = metrics.off_diagonal_of(src.embedding_clips(spark, d))
    return o.select(r("off_diag_mean").alias("off_diag_mean"), r("off_diag_std").alias("off_diag_std"))


@query()
def effective_rank(spark, d):
    return spark.createDataFrame([(round(metrics.effective_rank(src.embedding_clips(spark, d)), 6),)], "z_effective_rank double")


@query(f"""WITH {CLIPS}, {sql_dtw(_BATCH_PAIRS)}, p AS (SELECT d.i, d.j, round(d.sim, 9) t, round(list_dot_product(a.z, b.z), 9) s FROM dtw d JOIN clips a ON a.clip_idx = d.i JOIN clips b ON b.clip_idx = d.j),
k AS (SELECT row_number() OVER (ORDER BY s, i, j)::DOUBLE x, row_number() OVER (ORDER BY t, i, j)::DOUBLE y FROM p) SELECT round((count(*) - 1) / count(*) * corr(x, y), 6) AS spearman FROM k""")
def spearman(spark, d):
    c = src.embedding_clips(spark, d)
    p = _batch_pairs(c).where("i < j")
    t = topk.dtw_pairs(p.select(F.col("i").alias("clip_idx"), F.col("j").alias("neighbor_idx")), c).withColumnsRenamed({"clip_idx": "i", "neighbor_idx": "j", "sim": "t"})
    both = p.select("i", "j", arrays.dot(F.col("za"), F.col("zb")).alias("s")).join(t, ["i", "j"])
    return metrics.spearman(both, "s", "t", ["i", "j"]).select(r("spearman").alias("spearman"))


# Losses.


def _alignment_sql(target):
    return f"""p AS (SELECT a.clip_idx // 25 AS batch, a.clip_idx i, b.clip_idx j, list_dot_product(a.z, b.z) / 0.07 AS pl, {target} AS t FROM clips a JOIN clips b ON a.clip_idx <> b.clip_idx AND a.clip_idx // 25 = b.clip_idx // 25),
s AS (SELECT batch, avg(t) m, stddev_samp(t) sd FROM p WHERE i < j GROUP BY 1), n AS (SELECT p.batch, i, j, pl, (t - m) / (sd + 1e-8) / 0.5 AS tl FROM p JOIN s USING (batch)),
x AS (SELECT batch, i, pl - max(pl) OVER w - ln(sum(exp(pl)) OVER w / exp(max(pl) OVER w)) AS lp, exp(tl - max(tl) OVER w) / (sum(exp(tl)) OVER w / exp(max(tl) OVER w)) AS q FROM n WINDOW w AS (PARTITION BY batch, i)),
rows_ AS (SELECT batch, i, -sum(q * lp) AS ce, -sum(q * ln(q + 1e-12)) AS h FROM x GROUP BY 1, 2)"""


_EUCLID = "-list_distance(a.z[1:32], b.z[1:32])"


@query(f"WITH {CLIPS}, {_alignment_sql(_EUCLID)} SELECT batch, round(avg(ce), 6) AS loss, round(avg(h), 6) AS entropy, round(avg(ce) - avg(h), 6) AS kl FROM rows_ GROUP BY batch")
def alignment_loss(spark, d):
    p = _loss_pairs(src.embedding_clips(spark, d))
    a = losses.alignment(p, "pred", "target", 0.07, 0.5)
    return a.select("batch", *(r(x).alias(x) for x in ("loss", "entropy", "kl")))


def _loss_pairs(c):
    p = _batch_pairs(c)
    half = lambda x: F.slice(x, 1, 32)
    return p.select("batch", "i", "j", arrays.dot(F.col("za"), F.col("zb")).alias("pred"), (-arrays.euclidean(half("za"), half("zb"))).alias("target"), (-arrays.euclidean(F.slice("za", 33, 32), F.slice("zb", 33, 32))).alias("target2"))


_SEM = _alignment_sql("-list_distance(a.z[33:64], b.z[33:64])")
for _n in ("p", "s", "n", "x", "rows_"):
    _SEM = _SEM.replace(f"{_n} AS (", f"{_n}2 AS (")
_SEM = _SEM.replace("FROM p WHERE", "FROM p2 WHERE").replace("FROM p JOIN s USING", "FROM p2 p JOIN s2 s USING").replace("FROM n WINDOW", "FROM n2 WINDOW").replace("FROM x GROUP", "FROM x2 GROUP")


@query(f"""WITH {CLIPS}, {_alignment_sql(_EUCLID)}, {_SEM}, b AS (SELECT t.batch, avg(t.ce) a, avg(u.ce) c FROM rows_ t JOIN rows_2 u USING (batch, i) GROUP BY 1)
SELECT round(avg(a), 6) AS trajectory, round(avg(c), 6) AS semantic, round(avg(a + 0.5 * c), 6) AS total FROM b""")
def combined_loss(spark, d):
    """Epoch means over batches."""
    p = _loss_pairs(src.embedding_clips(spark, d))
    both = losses.combined(losses.alignment(p, "pred", "target", 0.07, 0.5), losses.alignment(p, "pred", "target2", 0.07, 0.5), 0.5)
    return both.agg(*(r(F.avg(x)).alias(x) for x in ("trajectory", "semantic", "total")))


# Mining.

_TRAIN_EDGES = f"{split_sql()}, {sql_dtw_edges(K)}, edges AS (SELECT t.*, a.video_number va, b.video_number vb FROM target t JOIN clips a ON a.clip_idx = t.clip_idx JOIN clips b ON b.clip_idx = t.neighbor_idx WHERE t.clip_idx IN (SELECT clip_idx FROM train) AND t.neighbor_idx IN (SELECT clip_idx FROM train))"


@query(f"WITH {CLIPS}, {_TRAIN_EDGES} SELECT * FROM (SELECT clip_idx, row_number() OVER (PARTITION BY clip_idx ORDER BY rank)::INT AS place, neighbor_idx FROM edges WHERE va <> vb) WHERE place <= 5")
def mined_positives(spark, d):
    c, train, _ = _split(spark, d)
    return sampler.positives(topk.dtw_topk(c, K), c, train, 5)


@query(f"WITH {CLIPS}, {_TRAIN_EDGES} SELECT * FROM (SELECT clip_idx, row_number() OVER (PARTITION BY clip_idx ORDER BY md5('{SEED}-' || clip_idx::VARCHAR || '-' || neighbor_idx::VARCHAR), neighbor_idx)::INT AS place, neighbor_idx FROM edges WHERE rank BETWEEN 11 AND 20) WHERE place <= 2")
def mined_boundaries(spark, d):
    c, train, _ = _split(spark, d)
    return sampler.rank_range_sample(topk.dtw_topk(c, K), c, train, 11, 20, 2, SEED)


@query()
def mined_batches(spark, d):
    return _mined(spark, d).batches


def _mined(spark, d):
    c, train, _ = _split(spark, d)
    return mining.mine(topk.dtw_topk(c, K), c, train, [0, 1], seed=SEED, batch_size=40, positives=3)


@query()
def mining_counters(spark, d):
    """Batches, pads, skipped and left anchors of two epochs of set-and-rank groups."""
    c, train, _ = _split(spark, d)
    return mining.mine(topk.dtw_topk(c, K), c, train, [0, 1], seed=SEED, batch_size=40, positives=2, boundaries=2, other_video=True).counters


@query(f"""WITH {CLIPS}, {sql_dtw_edges(K)}, m AS (SELECT clip_idx // 10 AS batch, clip_idx AS anchor, 0 AS slot, 'anchor' AS role, clip_idx AS c FROM clips
UNION ALL SELECT clip_idx // 10, clip_idx, rank, 'positive', neighbor_idx FROM target WHERE rank <= 2 UNION ALL SELECT clip_idx // 10, clip_idx, 3, 'boundary', neighbor_idx FROM target WHERE rank = 11),
s AS (SELECT a.clip_idx AS anchor, b.clip_idx AS c, list_dot_product(a.z, b.z) AS sim FROM clips a, clips b WHERE a.clip_idx <> b.clip_idx),
e AS (SELECT m.batch, m.anchor, m.slot, m.role, m.c, s.sim, t.sim AS dtw FROM m JOIN s USING (anchor, c) JOIN target t ON t.clip_idx = m.anchor AND t.neighbor_idx = m.c WHERE m.role <> 'anchor'),
pos AS (SELECT batch, anchor, sim AS psim FROM e WHERE role = 'positive'), bd AS (SELECT batch, anchor, c, sim FROM e WHERE role = 'boundary'),
oth AS (SELECT x.batch, x.anchor, y.c FROM m x JOIN (SELECT DISTINCT batch, c FROM m) y ON x.batch = y.batch WHERE x.role = 'anchor' AND y.c <> x.anchor AND NOT EXISTS (SELECT 1 FROM target t WHERE t.clip_idx = x.anchor AND t.neighbor_idx = y.c AND t.rank <= 10) AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.batch = x.batch AND bd.anchor = x.anchor AND bd.c = y.c)),
ex AS (SELECT batch, anchor, c, sim FROM (SELECT o.batch, o.anchor, o.c, s.sim, row_number() OVER (PARTITION BY o.batch, o.anchor ORDER BY round(s.sim, 9) DESC, o.c) k FROM oth o JOIN s USING (anchor, c)) WHERE k <= 4),
neg AS (SELECT * FROM bd UNION ALL SELECT * FROM ex), tm AS (SELECT batch, anchor, psim, neg.sim AS nsim FROM pos JOIN neg USING (batch, anchor)),
st AS (SELECT batch, avg(greatest((nsim - psim + 0.1) / 0.1, 0) + ln(1 + exp(-abs((nsim - psim + 0.1) / 0.1)))) AS set_loss, avg(CASE WHEN nsim >= psim THEN 1.0 ELSE 0.0 END) AS set_violation FROM tm GROUP BY 1),
mg AS (SELECT batch, avg(psim - top) AS positive_margin FROM pos JOIN (SELECT batch, anchor, max(sim) top FROM neg GROUP BY 1, 2) USING (batch, anchor) GROUP BY 1),
rk AS (SELECT batch, avg(greatest(-w / 0.1, 0) + ln(1 + exp(-abs(w / 0.1)))) AS rank_loss, avg(CASE WHEN w <= 0 THEN 1.0 ELSE 0.0 END) AS rank_violation FROM (SELECT a.batch, sign(a.dtw - b.dtw) * (a.sim - b.sim) AS w FROM e a JOIN e b ON a.batch = b.batch AND a.anchor = b.anchor AND a.slot < b.slot WHERE a.dtw <> b.dtw) GROUP BY 1)
SELECT batch, round(set_loss, 6) AS set_loss, round(rank_loss, 6) AS rank_loss, round(set_loss + rank_loss, 6) AS total, round(set_violation, 6) AS set_violation, round(rank_violation, 6) AS rank_violation, round(positive_margin, 6) + 0.0 AS positive_margin FROM st JOIN mg USING (batch) LEFT JOIN rk USING (batch)""")
def set_rank_loss(spark, d):
    """Every clip anchors a group of two positives and one boundary; ten groups make a batch."""
    c = src.embedding_clips(spark, d)
    cache = written(topk.dtw_topk(c, K), "cache")  # read several times; K rows a clip
    batch = F.expr("clip_idx div 10").alias("batch")
    pick = lambda cond, role, slot: cache.where(cond).select(batch, F.col("clip_idx").alias("anchor"), slot.cast("int").alias("slot"), F.lit(role).alias("role"), F.col("neighbor_idx").alias("clip_idx"))
    members = c.select(batch, F.col("clip_idx").alias("anchor"), F.lit(0).alias("slot"), F.lit("anchor").alias("role"), "clip_idx")
    members = members.unionByName(pick("rank <= 2", "positive", F.col("rank"))).unionByName(pick("rank = 11", "boundary", F.lit(3)))
    here = members.select("batch", "clip_idx").distinct()
    z = c.select("clip_idx", "z")
    sims = members.where("role = 'anchor'").select("batch", "anchor").join(here, "batch").select("anchor", "clip_idx").distinct()
    sims = sims.join(z, "clip_idx").withColumnsRenamed({"clip_idx": "neighbor_idx", "z": "zb", "anchor": "clip_idx"}).join(z, "clip_idx").select("clip_idx", "neighbor_idx", arrays.dot(F.col("z"), F.col("zb")).alias("sim"))
    distinct = members.dropDuplicates(["batch", "anchor", "clip_idx"])
    out = losses.set_rank(distinct, written(sims, "sims"), cache, 10, 5)
    return out.select("batch", *(r(x).alias(x) for x in ("set_loss", "rank_loss", "total", "set_violation", "rank_violation", "positive_margin")))


@query("""WITH q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p)
SELECT event_type, p, count(*) AS n, TRUE AS within FROM events, q WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""")
def sketched_quantiles(spark, d):
    """Quantiles of each event type's values from merged sketches of its users' tenths, and whether their exact ranks are within
    the sketches' error."""
    e = src.table(spark, d, "events").withColumn("tenth", F.col("user_id") % 10)
    found = written(observed.quantiles(observed.merged(observed.sketches(e, ["event_type", "tenth"], "value"), ["event_type"]), [0.05, 0.25, 0.5, 0.75, 0.95]), "quantiles")
    ranks = observed.rank_bounds(e, ["event_type"], "value", found)
    within = (F.col("below") <= F.col("p") + observed.RANK_ERROR) & (F.col("upto") >= F.col("p") - observed.RANK_ERROR)
    return found.join(ranks, ["event_type", "p", "value"]).select("event_type", "p", "n", within.alias("within"))


# Models.


@query()
def prototype_activations(spark, d):
    import numpy as np

    rng = np.random.default_rng(SEED)
    w = {"prototypes": rng.normal(size=(8, 6, 4)) * 0.1, "bn.mean": np.zeros(8), "bn.var": np.ones(8), "bn.weight": np.ones(8), "bn.bias": np.zeros(8)}
    c = src.embedding_clips(spark, d).withColumn("frames", transforms.pad_to(F.col("frames"), F.lit(16)))
    return model.encode(c, lambda x, mask: model.prototype_activations(x, w))


@query()
def projected_embeddings(spark, d):
    w = model.random_weights(4, 16, 8, 2, 2, SEED)
    return model.encode(src.embedding_clips(spark, d), lambda x, mask: model.project(x, mask, w, 2, 4))
