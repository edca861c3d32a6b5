"""Forward values of the ranking losses, over batches of a pair table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import softplus
from ..scratch import written


def zscore(pairs: DataFrame, sim: str, batch: str = "batch", i: str = "i", j: str = "j", eps: float = 1e-8) -> DataFrame:
    """Adds `<sim>_z`: standardised by mean and sample deviation over each batch's pairs i < j."""
    w = Window.partitionBy(batch)
    upper = F.when(F.col(i) < F.col(j), F.col(sim))
    return pairs.withColumn(f"{sim}_z", (F.col(sim) - F.avg(upper).over(w)) / (F.stddev_samp(upper).over(w) + eps))


def _log_softmax(x: Column, row) -> Column:
    top = F.max(x).over(row)
    return x - top - F.log(F.sum(F.exp(x - top)).over(row))


def with_softmax(pairs: DataFrame, pred: str, target: str, tau_pred: float, tau_target: float, batch: str = "batch", i: str = "i", j: str = "j") -> DataFrame:
    """Adds log_pred and soft, each row's distributions over the others of its batch; the diagonal takes no part."""
    row = Window.partitionBy(batch, i)
    z = zscore(pairs.where(F.col(i) != F.col(j)), target, batch, i, j)
    z = z.withColumns({"_p": F.col(pred) / tau_pred, "_t": F.col(f"{target}_z") / tau_target})
    return z.withColumns({"log_pred": _log_softmax(F.col("_p"), row), "soft": F.exp(_log_softmax(F.col("_t"), row))}).drop("_p", "_t")


def alignment(pairs: DataFrame, pred: str, target: str, tau_pred: float, tau_target: float, batch: str = "batch", i: str = "i", j: str = "j") -> DataFrame:
    """(batch, loss, entropy, kl): soft cross-entropy, its floor in nats, and their gap, means over rows."""
    rows = with_softmax(pairs, pred, target, tau_pred, tau_target, batch, i, j).groupBy(batch, i).agg((-F.sum(F.col("soft") * F.col("log_pred"))).alias("ce"), (-F.sum(F.col("soft") * F.log(F.col("soft") + 1e-12))).alias("h"))
    return rows.groupBy(batch).agg(F.avg("ce").alias("loss"), F.avg("h").alias("entropy")).withColumn("kl", F.col("loss") - F.col("entropy"))


def combined(trajectory: DataFrame, semantic: DataFrame, weight: float, batch: str = "batch", components: str = "both") -> DataFrame:
    """(batch, trajectory, semantic, total) of two alignment losses; `components` names what counts."""
    if components not in ("both", "trajectory", "semantic"):
        raise ValueError(f"unknown components {components!r}")
    a, b = trajectory.select(batch, F.col("loss").alias("trajectory")), semantic.select(batch, F.col("loss").alias("semantic"))
    total = {"both": F.col("trajectory") + weight * F.col("semantic"), "trajectory": F.col("trajectory"), "semantic": F.lit(weight) * F.col("semantic")}[components]
    return a.join(b, batch).withColumn("total", total)


def epoch_mean(losses: DataFrame, value: str = "loss") -> DataFrame:
    """One row: the mean over batches, whatever their sizes."""
    return losses.agg(F.avg(value).alias(value))


def set_rank(members: DataFrame, sims: DataFrame, cache: DataFrame, positive_top_k: int, hard_negatives: int, margin: float = 0.1, set_temperature: float = 0.1, rank_temperature: float = 0.1, set_weight: float = 1.0, rank_weight: float = 1.0) -> DataFrame:
    """(batch, set_loss, rank_loss, total, set_violation, rank_violation, positive_margin) of mined batches.

    members(batch, anchor, slot, role, clip_idx): a batch's clips by group, with roles anchor, positive and boundary;
    sims(clip_idx, neighbor_idx, sim): the model's similarity of clips; cache(clip_idx, rank, neighbor_idx, dtw_sim).
    Negatives of an anchor are the batch's clips but itself and its first `positive_top_k` cached neighbours; its
    boundary clips always count, and the hardest others fill up to `hard_negatives`, ties to the smaller
    id. A candidate that the cache lacks raises.
    """
    anchors = members.where("role = 'anchor'").select("batch", "anchor")
    explicit = members.where("role != 'anchor'").select("batch", "anchor", "slot", "role", F.col("clip_idx").alias("c"))
    sim = sims.select(F.col("clip_idx").alias("anchor"), F.col("neighbor_idx").alias("c"), "sim")
    cached = cache.select(F.col("clip_idx").alias("anchor"), F.col("neighbor_idx").alias("c"), "rank", "dtw_sim")

    scored = explicit.join(sim, ["anchor", "c"]).join(cached.select("anchor", "c", "dtw_sim"), ["anchor", "c"], "left")
    scored = scored.withColumn("dtw_sim", F.when(F.col("dtw_sim").isNull(), F.raise_error(F.lit("candidate missing from the neighbour cache")).cast("double")).otherwise(F.col("dtw_sim")))
    scored = written(scored, "scored")  # a batch's groups; three terms read it
    positives = scored.where("role = 'positive'").select("batch", "anchor", F.col("c").alias("p"), F.col("sim").alias("psim"))
    boundary = scored.where("role = 'boundary'").select("batch", "anchor", "c", "sim")

    known = cached.where(F.col("rank") <= positive_top_k).select("anchor", "c")
    others = anchors.join(members.select("batch", F.col("clip_idx").alias("c")).distinct(), "batch").where("c != anchor")
    others = others.join(known, ["anchor", "c"], "left_anti").join(boundary.select("batch", "anchor", "c"), ["batch", "anchor", "c"], "left_anti")
    n_boundary = boundary.groupBy("batch", "anchor").agg(F.count("*").alias("nb"))
    hardest = Window.partitionBy("batch", "anchor").orderBy(F.round("sim", 9).desc(), "c")
    extra = others.join(sim, ["anchor", "c"]).join(n_boundary, ["batch", "anchor"], "left").withColumn("k", F.row_number().over(hardest)).where(F.col("k") <= hard_negatives - F.coalesce("nb", F.lit(0)))
    negatives = boundary.unionByName(extra.select("batch", "anchor", "c", "sim")).withColumnsRenamed({"c": "n", "sim": "nsim"})
    negatives = written(negatives, "negatives")

    terms = positives.join(negatives, ["batch", "anchor"])
    gap = F.col("nsim") - F.col("psim")
    sets = terms.groupBy("batch").agg(F.avg(softplus((gap + margin) / set_temperature)).alias("set_loss"), F.avg((gap >= 0).cast("double")).alias("set_violation"))
    top = negatives.groupBy("batch", "anchor").agg(F.max("nsim").alias("top"))
    margins = positives.join(top, ["batch", "anchor"]).groupBy("batch").agg(F.avg(F.col("psim") - F.col("top")).alias("positive_margin"))
    a, b = scored.alias("a"), scored.alias("b")
    ordered = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.slot") < F.col("b.slot")))
    delta = F.col("a.dtw_sim") - F.col("b.dtw_sim")
    wanted = F.signum(delta) * (F.col("a.sim") - F.col("b.sim"))
    ranks = ordered.where(delta != 0).groupBy(F.col("a.batch").alias("batch")).agg(F.avg(softplus(-wanted / rank_temperature)).alias("rank_loss"), F.avg((wanted <= 0).cast("double")).alias("rank_violation"))
    out = sets.join(margins, "batch").join(ranks, "batch", "left").fillna(0.0, ["rank_loss", "rank_violation"])
    return out.withColumn("total", set_weight * F.col("set_loss") + rank_weight * F.col("rank_loss"))
