"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: after centring, learned rotations (iterative quantization, each from another
random start) are followed by signs. A code is split into 16-bit substrings, each indexed by its value. By the
pigeonhole principle, a code within radius r of the query's has a substring within its share of r, so probing
every bucket within that share finds all of them; their distances are then computed in double
precision on the original vectors.

Rows and queries are dealt into blocks by hash, and each pair of blocks is searched in one task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a code; radius as a share of them; rows that the rotations are fitted on at most.
BITS, RADIUS, SAMPLE = 256, 0.42, 10_000
#: Rows and queries in a block; candidates of a block that are ranked at least, for each neighbour asked for.
ROWS, QUERIES, POOL = 20_000, 4_096, 25


@lru_cache(maxsize=1)
def _ones() -> np.ndarray:
    return np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)).astype(np.uint8)


def learn_rotations(x: np.ndarray, bits: int, seed: int = 7, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of dim x bits) by iterative quantization."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    x = x - mean
    d, parts = x.shape[1], []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        parts.append(r)
    return mean, np.hstack(parts)[:, :bits]


def codes(x: np.ndarray, model) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    return np.packbits((x - model[0]) @ model[1] >= 0, axis=1).view(np.uint16)


class MultiIndex:
    """For each substring, its values in a block and the rows of each value."""

    def __init__(self, code: np.ndarray):
        self.code, self.tables = code, []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            values, starts = np.unique(code[order, j], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows within the radius of a code, and their distances: with radius = m * share + rest, some substring
        differs in `share` bits at most among the first rest + 1, or in share - 1 among the others."""
        m, ones = len(self.tables), _ones()
        share, rest = divmod(radius, m)
        hit = np.zeros(len(self.code), bool)
        for j, (order, values, starts) in enumerate(self.tables):
            near = ones[values ^ query[j]] <= share - (j > rest)
            sizes = np.diff(starts)
            hit[order[np.repeat(near, sizes)]] = True
        rows = np.flatnonzero(hit)
        far = ones[self.code[rows] ^ query].sum(1, dtype=np.int64)
        keep = far <= radius
        return rows[keep], far[keep]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, model, k: int, share: float, pool: int):
    """(query, row's id, distance) of the k nearest found in a block for each query; the radius grows
    until `pool` rows are within it, or all rows have been seen."""
    index, bits = MultiIndex(codes(x, model)), model[1].shape[1]
    for qid, v, code in zip(query_ids, q, codes(q, model), strict=True):
        others = int((ids != qid).sum())
        radius = int(share * bits)
        while True:
            rows, _ = index.within(code, radius)
            rows = rows[ids[rows] != qid]
            if len(rows) >= min(pool, others) or radius >= bits:
                break
            radius = min(bits, radius + bits // 16)
        dist = np.sqrt(((x[rows] - v) ** 2).sum(1))
        top = np.lexsort((ids[rows], dist))[:k]
        for r, d in zip(rows[top], dist[top], strict=True):
            yield int(qid), int(ids[r]), float(d)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, bits: int = BITS, radius: float = RADIUS, sample: int = SAMPLE, block_rows: int = ROWS) -> DataFrame:
    """For each row that `is_query` (a Column) selects, its k nearest other rows found by Euclidean distance: query_id, rank
    from 1, vec_id, score (the distance). Ties go to the smaller id.

    Rows with a null id or vector, a zero vector, or null or non-finite components take no part, nor do vectors of another
    length than the most frequent one (the shorter of equally frequent). Rows that repeat an id and a vector
    are one; a query has no answers from rows of its own id. Fewer rows than k give all of them; an empty table
    gives none. Rotations are fitted on the `sample` rows first in hash order.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    v = F.col("v")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    clean = clean.where("id is not null and v is not null and size(v) > 0").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    shape = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    dim, n = shape["d"], shape["count"]
    clean = clean.where(F.size("v") == dim)
    first = np.array([r.v for r in clean.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()])  # `sample` rows
    model = spark.sparkContext.broadcast(learn_rotations(first, bits))

    n_blocks = max(1, -(-n // block_rows))
    n_queries = clean.where("q").count()
    q_blocks = max(1, -(-n_queries // QUERIES))
    deal = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = clean.select("id", "v", deal(n_blocks, 1).alias("rb"), each(q_blocks).alias("qb"))
    asked = clean.where("q").select(F.col("id").alias("qid"), F.col("v").alias("qv"), deal(q_blocks, 2).alias("qqb"), each(n_blocks).alias("qrb"))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        def matrix(t, i, c):
            ids, x = t[i].to_numpy(), t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            _, once = np.unique(np.column_stack([ids.astype(float), x]), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (None, np.arange(len(ids)))
            return ids[once], x[once]

        found = []
        if len(rows) and len(asked):
            found = list(search_block(*matrix(rows, "id", "v"), *matrix(asked, "qid", "qv"), model.value, k, radius, POOL * k))
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    found = rows.groupBy("rb", "qb").cogroup(asked.groupBy("qrb", "qqb")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
