"""All pairs of rows, in blocks.

Rows are dealt into blocks by hash, and each unordered pair of blocks meets in one task, where numpy scores all
its pairs; what leaves a task is what the caller keeps of them (the k best of each row, or a sum), so pairs are
never a table. A row is sent once for each block.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; tasks that pairs of blocks are dealt to, at most.
ROWS, TASKS = 512, 2000


def n_blocks(df: DataFrame, rows: int = ROWS) -> int:
    return max(1, -(-df.count() // rows))


def spread(n: int, rows: int, cores: int, least: int = 64, each: int = 3) -> int:
    """How many blocks n rows are dealt to: `rows` in each at most, and fewer where a small table would else have less than
    `each` pairs of blocks for each core; not under `least`."""
    blocks = max(1, -(-n // rows))
    while blocks * (blocks + 1) // 2 < each * cores and n // (blocks + 1) >= least:
        blocks += 1
    return blocks


def block_pairs(df: DataFrame, key: str, run: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, rows: int = ROWS, each_core: int = 3) -> DataFrame:
    """run(left, right, same) over every unordered pair of blocks; `same` tells that both are one block."""
    n = spread(df.count(), rows, df.sparkSession.sparkContext.defaultParallelism, each=each_core)
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o"))
    # Pairs of two blocks are numbered before those of a block with itself, which are half the work and so start last; a block is
    # the left one of those where it comes first.
    i, j, apart = F.least("_b", "_o"), F.greatest("_b", "_o"), n * (n - 1) // 2
    pair = F.when(i == j, i + apart).otherwise(F.floor(i * (2 * n - 1 - i) / 2).cast("int") + j - i - 1)
    sent = met.select(pair.alias("_pair"), (F.col("_b") > F.col("_o")).alias("_right"), *df.columns)

    def each(key_, t):
        import pyarrow.compute as pc

        return run(t.filter(pc.invert(t["_right"])), t.filter(t["_right"]), key_[0].as_py() >= apart)

    # A task for each pair of blocks, by its number: dealt by hash, some tasks would have several and others none.
    return sent.repartitionById(min(n * (n + 1) // 2, TASKS), "_pair").groupBy("_pair").applyInArrow(each, schema)


def block_rectangle(queries: DataFrame, corpus: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int, key: str = "clip_idx", each_core: int = 3) -> DataFrame:
    """run(queries, corpus) over every block of queries with every block of a corpus, of the same columns, in a task for each pair.
    Queries go to smaller blocks first where the pairs would be less than `each_core` for each core, as what leaves a task
    grows with the blocks of the corpus."""
    nq, nc = queries.count(), corpus.count()
    i, j = max(1, -(-nq // rows)), max(1, -(-nc // rows))
    while i * j < each_core * queries.sparkSession.sparkContext.defaultParallelism:
        if nq // (i + 1) >= ROWS:
            i += 1
        elif nc // (j + 1) >= ROWS:
            j += 1
        else:
            break
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("*", deal(i).alias("_i"), each(j).alias("_j"), F.lit(True).alias("_asks"))
    there = corpus.select("*", each(i).alias("_i"), deal(j).alias("_j"), F.lit(False).alias("_asks"))
    sent = asked.unionByName(there).select((F.col("_i") * j + F.col("_j")).alias("_pair"), "_asks", *queries.columns)

    def each_pair(t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        return run(t.filter(t["_asks"]), t.filter(pc.invert(t["_asks"])))

    return sent.repartitionById(min(i * j, TASKS), "_pair").groupBy("_pair").applyInArrow(each_pair, schema)
