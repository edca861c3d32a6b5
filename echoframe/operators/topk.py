"""Nearest neighbours: dynamic time warping or cosine, over all pairs or over candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, dtw, pooling
from ..functions.transforms import design as by_name
from ..scratch import written
from . import cells
from .best import EDGES, Asked, Running, best, running, slices
from .best import k_best as _k_best
from .best import table as _table
from .blocks import ROWS, block_pairs, block_rectangle, n_blocks


#: Clips of a block whose pairs with another block are scored in single precision: a matrix of 64 MB.
NEAR = 8 * ROWS
#: Rows of a group, of which two meet in a task: what leaves it is k edges for each row, so these grow with the groups. Pairs of groups
#: for each core, at least.
GROUP, EACH = 32 * ROWS, 8
#: Pairs that wait for double precision in a task, about.
WAITING = 4_000_000
#: Explicit pairs of clips that a task joins with their frames, about.
PAIRS = 50_000


def mirror(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("neighbor_idx").alias("clip_idx"), F.col("clip_idx").alias("neighbor_idx"), "sim"))


def _both_sides(left_ids, right_ids, sim, same: bool, k: int) -> pa.Table:
    if same:
        sim = np.where(left_ids[:, None] == right_ids[None], -np.inf, sim)
        return _k_best(left_ids, right_ids, sim, k)
    return pa.concat_tables([_k_best(left_ids, right_ids, sim, k), _k_best(right_ids, left_ids, sim.T, k)])


def _frames(column) -> list[np.ndarray]:
    clips = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    frames = clips.flatten()
    numbers = frames.flatten()
    width = len(numbers) // max(1, len(frames))
    if clips.null_count or frames.null_count or numbers.null_count or not width or (frames.value_lengths().to_numpy() != width).any():
        return [np.array(f, dtype=float) for f in column.to_pylist()]
    return np.split(numbers.to_numpy().astype(float).reshape(-1, width), np.cumsum(clips.value_lengths().to_numpy())[:-1])


def _vectors(column) -> np.ndarray:
    numbers = column.combine_chunks().flatten()
    width = len(numbers) // max(1, len(column))
    if column.null_count or numbers.null_count or (column.combine_chunks().value_lengths().to_numpy() != width).any():
        return np.array(column.to_pylist(), dtype=float)
    return numbers.to_numpy().astype(float).reshape(len(column), width)


def nearest(left: pa.Table, right: pa.Table, same: bool, k: int, method: str = "symmetric2", norm: str = "mean_length", both: bool = True, met: np.ndarray | None = None) -> pa.Table:
    """Edges to the k best of each clip of two groups, on the other side (in the `same` group, among the others); of the left one
    alone, if not `both`. All pairs are scored in single precision, slice by slice; those that its error leaves in question,
    against the k best of the whole group, are computed in double precision and ranked. No clip is near itself. Where `met` is
    given, clips have a `block`, and meet where it is true of their blocks, and a `limit`, which no neighbour exceeds."""
    f, li, lt = _by_length(left)
    g, ri, rt = (f, li, lt) if same else _by_length(right)
    own = same or len(np.intersect1d(li, ri)) > 0
    if met is not None:
        lb, rb = lt["block"].to_numpy(), rt["block"].to_numpy()

    def apart(s: slice, t: slice) -> np.ndarray | None:
        if met is not None:
            return ~met[lb[s]][:, rb[t]]
        return li[s, None] == ri[None, t] if own else None

    of = dtw.extent(f, g) if method == "symmetric2" else None
    mine = Running(li, k)
    theirs = mine if same else Running(ri, k)
    asked = Asked(k, len(li), len(ri), same)

    def exact(s: slice, t: slice, once: bool) -> None:
        for at in range(s.start, s.stop, ROWS):
            ai = li[at : min(at + ROWS, s.stop)]
            sim = -dtw.cross(f[at : at + len(ai)], g[t], None, method, norm)
            if (none := apart(slice(at, at + len(ai)), t)) is not None:
                sim[none] = -np.inf
            mine.offer(sim, ri[t], at)
            if not once:
                theirs.offer(sim.T, ai, t.start)

    def settle() -> None:
        i, j, forth, back = asked.take()
        sim = -dtw.distances(f, g, (i, j), method, norm)
        mine.add(i[forth], ri[j[forth]], sim[forth])
        if both:
            theirs.add(j[back], li[i[back]], sim[back])

    for s in (every := slices(len(li), NEAR)):
        for t in [t for t in every if t.start >= s.start] if same else slices(len(ri), NEAR):
            once = not both or (same and s == t)
            enough = k < t.stop - t.start and (k < s.stop - s.start or not both)
            found = dtw.quick(f[s], g[t], norm, of) if of and enough else None
            if found is not None:
                near, asked.room = found
                if met is not None and not asked.held:
                    asked.limit(lt["limit"].to_numpy(), rt["limit"].to_numpy())
                if (none := apart(s, t)) is not None:
                    near[none] = np.inf
            if found is None or not asked.add(near, s, t, once):
                exact(s, t, once)
            if asked.held > WAITING:
                settle()
    settle()
    return mine.table() if same or not both else pa.concat_tables([mine.table(), theirs.table()])


def _by_length(clips: pa.Table) -> tuple[list[np.ndarray], np.ndarray, pa.Table]:
    frames = _frames(clips["frames"])
    order = np.argsort([len(x) for x in frames], kind="stable")
    return [frames[i] for i in order], clips["clip_idx"].to_numpy()[order], clips.drop_columns("frames").take(order)


def dtw_topk(clips: DataFrame, k: int, method: str = "symmetric2", norm: str = "mean_length", rows: int = GROUP) -> DataFrame:
    """(clip_idx, rank, neighbor_idx, dtw_sim): exact neighbours over all pairs, each unordered pair computed once."""

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        return nearest(left, left if same else right, same, k, method, norm)

    return ranked(block_pairs(clips.select("clip_idx", "frames"), "clip_idx", run, EDGES, rows, EACH), k)


def ranked(edges: DataFrame, k: int) -> DataFrame:
    return best(edges, k).select("clip_idx", "rank", "neighbor_idx", (F.col("sim") + 0.0).alias("dtw_sim"))


def dtw_topk_with_train(clips: DataFrame, train: DataFrame, k: int, method: str = "symmetric2", norm: str = "mean_length", rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """dtw_topk() of all clips and of the training clips among themselves, from one pass over the pairs, which is written by
    table; each of the two reads its part."""
    marked = clips.join(train.select("clip_idx", F.lit(True).alias("t")).distinct(), "clip_idx", "left").select("clip_idx", "frames", F.coalesce("t", F.lit(False)).alias("t"))

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        if same:
            right = left
        sim = -dtw.cross(_frames(left["frames"]), _frames(right["frames"]), None, method, norm)
        ids = left["clip_idx"].to_numpy(), right["clip_idx"].to_numpy()
        both = left["t"].to_numpy()[:, None] & right["t"].to_numpy()[None]
        tables = [_both_sides(*ids, np.where(keep, sim, -np.inf), same, k) for keep in (True, both)]
        return pa.concat_tables([t.append_column("train", pa.array([i == 1] * len(t), pa.bool_())) for i, t in enumerate(tables)])

    edges = written(block_pairs(marked, "clip_idx", run, EDGES + ", train boolean", rows), "pairs", ["train"])
    return ranked(edges.where("not train"), k), ranked(edges.where("train"), k)


def dtw_pairs(pairs: DataFrame, clips: DataFrame, method: str = "symmetric2", norm: str = "mean_length", per_clip: int = 0, rows: int = ROWS) -> DataFrame:
    """Adds `sim` to explicit pairs (clip_idx, neighbor_idx), each once. Where a clip has `per_clip` pairs, more than twice the
    blocks of clips, pairs of blocks meet and a clip is sent once to each; else both clips go with every pair."""
    n = n_blocks(clips, rows) if per_clip else 0
    spark = clips.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * rows * per_clip // PAIRS)
    if 0 < 2 * n <= per_clip:
        return _dtw_pairs_by_block(pairs, clips, n, method, norm)
    a = clips.select(F.col("clip_idx"), F.col("frames").alias("fa"))
    b = clips.select(F.col("clip_idx").alias("neighbor_idx"), F.col("frames").alias("fb"))

    def run(batches):
        for t in batches:
            n = t.num_rows
            at = np.arange(n)
            sim = -dtw.distances(_frames(t.column(2)), _frames(t.column(3)), (at, at), method, norm) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sim, pa.float64())], names=["clip_idx", "neighbor_idx", "sim"])

    # Pairs carry frames, so tasks are as many as these ask for: what one sorts does not grow with the table.
    there = pairs.select("clip_idx", "neighbor_idx").repartition(tasks, "neighbor_idx").join(b, "neighbor_idx").repartition(tasks, "clip_idx")
    return there.join(a, "clip_idx").select("clip_idx", "neighbor_idx", "fa", "fb").mapInArrow(run, EDGES)


def _dtw_pairs_by_block(pairs: DataFrame, clips: DataFrame, n: int, method: str, norm: str) -> DataFrame:
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    ends = block("clip_idx"), block("neighbor_idx")
    # Names of their own, as both sides may come from one table.
    asked = pairs.select(F.least(*ends).alias("pi"), F.greatest(*ends).alias("pj"), F.col("clip_idx").alias("a"), F.col("neighbor_idx").alias("b"))
    mine = clips.select("clip_idx", "frames").withColumn("b", block("clip_idx")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sent = mine.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "clip_idx", "frames")

    def run(pairs: pa.Table, clips: pa.Table) -> pa.Table:
        if not len(pairs):
            return _table([], [], [])
        ids, once = np.unique(clips["clip_idx"].to_numpy(), return_index=True)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        known = np.isin(a, ids) & np.isin(b, ids)
        a, b = a[known], b[known]
        x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
        # A pair that both clips ask for is computed once.
        pair, back = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y), return_inverse=True)
        frames = _frames(clips["frames"].take(once))
        sim = -dtw.distances(frames, frames, np.divmod(pair, len(ids)), method, norm)[back]
        return pa.table([pa.array(a), pa.array(b), pa.array(sim, pa.float64())], names=["clip_idx", "neighbor_idx", "sim"])

    return asked.groupBy("pi", "pj").cogroup(sent.groupBy("i", "j")).applyInArrow(run, EDGES)


def dtw_against(queries: DataFrame, corpus: DataFrame, k: int, rows: int = GROUP) -> DataFrame:
    """The k nearest clips of a corpus for each query clip, itself not counted: every block of queries meets every block
    of the corpus, and nothing else meets."""
    return ranked(dtw_between(queries, corpus, k, False, rows), k)


def dtw_between(queries: DataFrame, corpus: DataFrame, k: int, both: bool = True, rows: int = GROUP) -> DataFrame:
    """(clip_idx, neighbor_idx, sim): what blocks of queries and of a corpus leave, the k best of each query within a pair of
    blocks, and of each corpus clip among the queries where `both` are asked for; each pair is computed once."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return nearest(q, c, False, k, both=both) if len(q) and len(c) else _table([], [], [])

    columns = ["clip_idx", "frames"]
    return block_rectangle(queries.select(columns), corpus.select(columns), run, EDGES, rows)


def cosine_topk(vectors: DataFrame, k: int, vector: str = "z", rows: int = GROUP) -> DataFrame:
    """(clip_idx, rank, neighbor_idx, sim) by inner product of vectors as they are, over all pairs; own rows are left out by id."""

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        if same:
            right = left
        x, y = (_vectors(t[vector]) for t in (left, right))
        li, ri = left["clip_idx"].to_numpy(), right["clip_idx"].to_numpy()

        def score(s: slice, t: slice, mine, theirs) -> None:
            if not len(li[s]) or not len(ri[t]):
                return
            sim = x[s] @ y[t].T
            if same:
                sim[li[s, None] == ri[None, t]] = -np.inf
            mine.offer(sim, ri[t])
            if theirs is not None:
                theirs.offer(sim.T, li[s])

        return running(li, ri, same, k, 4 * ROWS, score)

    return best(block_pairs(vectors.select("clip_idx", vector), "clip_idx", run, EDGES, rows, EACH), k).select("clip_idx", "rank", "neighbor_idx", "sim")


cosine_against = cells.against

#: Candidate searches by name: each takes vectors (clip_idx, z) and k.
INDEXES = {"exhaustive": cosine_topk, "cells": cells.cell_topk}


def filtered_topk(clips: DataFrame, k: int, candidate_k: int, kind: str = "stats4", width: int | None = None, dim: int | None = None, index: str = "exhaustive") -> DataFrame:
    """Neighbours by filter and refine: pooled vectors choose `candidate_k` candidates by cosine, through the index that is
    named, and exact distances rank them."""
    if index not in INDEXES:
        raise ValueError(f"{index!r} is not one of {sorted(INDEXES)}")
    pooled = clips.select("clip_idx", arrays.l2_normalize(pooling.pool(F.col("frames"), kind, width, dim)).alias("z"))
    return ranked(dtw_pairs(INDEXES[index](pooled, candidate_k), clips, per_clip=candidate_k), k)


def build(clips: DataFrame, k: int, candidate_k: int, kind: str = "stats4", design: str = "abs_21j_coords", width: int | None = None, dim: int | None = None, index: str = "exhaustive") -> tuple[DataFrame, dict]:
    """A neighbour table and its metadata: all pairs where candidate_k is 0 or less, else filter and refine."""
    d = by_name(design)
    everything = candidate_k <= 0
    table = dtw_topk(clips, k, d.method, d.norm) if everything else filtered_topk(clips, k, candidate_k, kind, width, dim, index)
    meta = {"design": design, "top_k": k, "candidate_k": -1 if everything else candidate_k, "pooling": None if everything else kind, "dtw_mode": "exact_all_pairs" if everything else "exact", "n": clips.count()}
    return table, meta


def train_pool(clips: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """Neighbours among the training clips only, for those clips only."""
    return dtw_topk(clips.join(train.select("clip_idx"), "clip_idx", "left_semi"), k)


def sanity_check(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """mean, min and max share of the exact k neighbours that the approximate table holds."""
    hit = exact.where(F.col("rank") <= k).join(approx.where(F.col("rank") <= k).select("clip_idx", "neighbor_idx", F.lit(1).alias("hit")), ["clip_idx", "neighbor_idx"], "left")
    per = hit.groupBy("clip_idx").agg((F.count("hit") / F.count("*")).alias("recall"))
    return per.agg(F.avg("recall").alias("mean"), F.min("recall").alias("min"), F.max("recall").alias("max"))
