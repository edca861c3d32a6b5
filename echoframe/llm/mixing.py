"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, in hash order, form a stream of words that is cut into blocks of equal length. The
schedule is a row of slots; slot k falls on the golden-ratio point frac(k / phi), and the source whose
interval of cumulative weights holds that point gets the slot. The r-th slot of a source takes its block
r mod (number of its blocks), so that a source is read in whole passes and one partial pass at
the end. Ranks and offsets are computed in two levels (within a shard, and over the shards of a source),
so that no window holds all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, null last, repeating; the most passes over a source.
WEIGHTS, PASSES = (5, 2, 1), 3
#: Words in a block; shards of a source; slots in a shard of the schedule; cells of the unit interval.
BLOCK, SHARDS, RUN, CELLS = 1024, 256, 4096, 4096
#: The odd integer nearest 2**31 / golden ratio: k * STEP mod 2**31 is the golden-ratio sequence in integers.
STEP, RANGE = 1327217885, 2**31


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(common.WORD)).cast("long")


def target_words(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with `target`, double.

    Sources weigh 5, 2, 1, repeating, in code-point order with null last, and share all words; a target stops at
    PASSES times its source's size, and the excess goes to the others by weight until none is above. That is a
    water level: with sources ordered by cap over weight, the first k are full, where k is the first for
    which the level left for the others does not pass the next cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    # One row for each source: small next to the documents.
    s = sources.withColumn("w", w).withColumn("cap", F.lit(float(PASSES)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(whole).cast("double"), "all_w": F.sum("w").over(whole)})
    left_words = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left_words / left_weight).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def _offset(df: DataFrame, keys: list[str], amount: str, out: str) -> DataFrame:
    """One row per key and shard: `out` is the sum of `amount` over the rows of the key's earlier shards."""
    shards = df.groupBy(*keys, "shard").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn(out, F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, size (its words), source_size, target and taken (the words of it that the
    mix takes, repeats counted).

    Null text has size 0 and is never taken; null sources form one source, last in order. Repeated rows are
    rows of their own. No row is taken more than PASSES times its size; each source's taken words are its target
    rounded. Reruns agree: the order within a source is by hash of id and seed, then id, then size. An empty
    table gives none; where no row has words, targets and taken are 0. Other columns are not read.
    """
    return _mix(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size")), block, seed).select("doc_id", "size", "source_size", "target", "taken")


def _mix(rows: DataFrame, block: int, seed: int) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a null source joins as a key of its own
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = rows.withColumns({"src": key, "shard": F.pmod(F.shiftrightunsigned(order, 40), F.lit(SHARDS)).cast("int"), "order": order})
    rows = common.materialize(rows, "mixing-rows")  # narrow rows: texts are read once
    sizes = rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    targets = target_words(sizes.select("source", "source_size")).withColumn("src", key)
    targets = targets.withColumn("amount", F.least(F.round("target").cast("long"), PASSES * F.col("source_size")))
    n_blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    plan = targets.withColumns({"n_blocks": n_blocks, "passes": F.when(F.col("source_size") > 0, F.expr("amount div source_size")).otherwise(0), "rest": F.when(F.col("source_size") > 0, F.expr("amount % source_size")).otherwise(0)})
    plan = common.materialize(plan.withColumn("slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / F.lit(block)).cast("long")), "mixing-plan")

    # How often each block is taken: in whole passes, and how many words of it in the last.
    times = (
        schedule(plan)
        .join(plan.select("src", "n_blocks", "passes", "rest"), "src")
        .select("src", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("pass"), "passes", "rest")
        .groupBy("src", "block")
        .agg(F.sum((F.col("pass") < F.col("passes")).cast("long")).alias("full"), F.max(F.when(F.col("pass") == F.col("passes"), F.least(F.lit(block), F.col("rest") - F.col("block") * block)).otherwise(0)).alias("part"))
    )

    # Offsets of documents in their source's stream.
    within = Window.partitionBy("src", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
    placed = rows.withColumns({"place": F.row_number().over(within), "upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(_offset(rows, ["src"], "size", "base"), ["src", "shard"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
    pieces = placed.where("size > 0").select("src", "shard", "place", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    part_end = F.col("block") * block + F.col("part")
    words = F.col("full") * (last - first) + F.greatest(F.lit(0), F.least(last, part_end) - first)
    taken = pieces.join(times.hint("merge"), ["src", "block"]).groupBy("src", "shard", "place").agg(F.sum(words).alias("taken"))
    return placed.join(taken, ["src", "shard", "place"], "left").join(plan.select("src", "source_size", "target"), "src").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long"))


def schedule(plan: DataFrame) -> DataFrame:
    """(src, slots) -> one row per slot: slot, src and rank among the source's slots, from 0.

    Slots follow the golden-ratio sequence through the cumulative weights. A source may get a slot more or
    less than its share by then: surplus slots are left out, and missing ones are added at the end.
    """
    order = Window.orderBy("src")
    bounds = plan.where("slots > 0").select("src", "slots", (F.sum("slots").over(order) - F.col("slots")).alias("lo"), F.sum("slots").over(order).alias("hi"), F.sum("slots").over(Window.partitionBy()).alias("all"))
    cell = lambda x: F.floor(x * CELLS / F.col("all")).cast("long")
    cells = bounds.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))))
    n = bounds.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n"))
    runs = n.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).otherwise(F.array().cast("array<long>"))).alias("shard"), "n")
    slots = runs.repartition("shard").select("shard", "n", F.explode(F.sequence(F.col("shard") * RUN, F.least((F.col("shard") + 1) * RUN, F.col("n")) - 1)).alias("slot"))
    point = F.expr(f"((slot % {RANGE}) * {STEP} % {RANGE}) / {float(RANGE)}")
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS).cast("long"))
    at = F.col("point") * F.col("all")
    dealt = slots.join(cells, "cell").where((at >= F.col("lo")) & (at < F.col("hi"))).select("slot", "shard", "src", "slots", F.lit(1).cast("long").alias("one"))
    base = _offset(dealt, ["src"], "one", "base")
    within = Window.partitionBy("src", "shard").orderBy("slot")
    ranked = dealt.withColumn("nth", F.row_number().over(within) - 1).join(base.hint("merge"), ["src", "shard"]).select("slot", "src", "slots", (F.col("base") + F.col("nth")).alias("rank"))
    got = dealt.groupBy("src").agg(F.count("*").alias("got"))
    missing = plan.where("slots > 0").select("src", "slots").join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    late = missing.select(F.lit(None).cast("long").alias("slot"), "src", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    return ranked.where("rank < slots").select("slot", "src", "rank").unionByName(late)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as mixed, with their columns: a row appears as often as the mix reads it to its end or in part
    (0 to PASSES times). Only the last pass may end inside a document, one for each source."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), count_words(F.col(text_col)).alias("words"), F.struct("*").alias("row"))
    mixed = mix(docs, id_col, text_col, source_col).where("taken > 0").select(F.col("doc_id").alias("mixed_id"), F.col("size").alias("words"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    # Rows that repeat an id and a size appear as often as the one that the mix reads most.
    mixed = mixed.groupBy("mixed_id", "words").agg(F.max("times").alias("times"))
    joined = rows.join(mixed, (rows["words"] == mixed["words"]) & rows["id"].eqNullSafe(mixed["mixed_id"]))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
