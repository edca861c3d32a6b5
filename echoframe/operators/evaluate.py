"""The metrics of a set of embeddings against neighbour tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, topk


def _width(edges: DataFrame) -> int:
    return edges.agg(F.max("rank")).first()[0] or 0


def _recalls(model, target, queries, ks, relevance, prefix=""):
    return {f"{prefix}R@{r.k}": r.recall for r in metrics.recall_at(model, target, queries, ks, relevance).collect()}


def _require_neighbours(model: DataFrame, queries: DataFrame, k: int) -> None:
    """RuntimeError where a query has fewer than k neighbours."""
    found = model.where(F.col("rank") <= k).groupBy("clip_idx").count()
    short = queries.select("clip_idx").join(found, "clip_idx", "left").where(F.coalesce("count", F.lit(0)) < k).count()
    if short:
        raise RuntimeError(f"{short} queries have fewer than {k} neighbours")


def in_set(vectors: DataFrame, target: DataFrame, ks: list[int], cknna_topk: int | list[int], relevance: int = 20, reference: DataFrame | None = None) -> dict[str, float]:
    """Metrics of embeddings (clip_idx, z) against the neighbour table of the same clips; with `reference`, a table by another
    similarity, its recalls and CKNNA as well (jepa_...). With several values of cknna_topk, the first names the plain
    metrics and each one cknna_dtw@k, from the same neighbours."""
    n = vectors.count()
    several = [cknna_topk] if isinstance(cknna_topk, int) else list(cknna_topk)
    k = min(several[0], n - 1)
    model = topk.cosine_topk(vectors, min(max([*ks, *several]), n - 1)).persist()
    out = _recalls(model, target, vectors, ks, relevance)
    for name, table, prefix in (("dtw", target, ""), ("jepa", reference, "jepa_")):
        if table is not None:
            out[f"cknna_{name}"] = metrics.cknna(model, table, k, n).first()[0]
            out[f"mutual_knn_{name}"] = metrics.mutual_knn(model, table, k, n).first()[0]
            if len(several) > 1:
                out |= {f"cknna_{name}@{x}": metrics.cknna(model, table, min(x, n - 1), n).first()[0] for x in several}
            if prefix:
                out |= _recalls(model, table, vectors, ks, relevance, prefix)
    model.unpersist()
    return out | health(vectors)


def against_pool(queries: DataFrame, corpus: DataFrame, target: DataFrame, ks: list[int], topks: list[int], prefix: str, relevance: int = 20) -> dict[str, float]:
    """Metrics of query embeddings against a corpus of embeddings that holds them: prefix_R@k, cknna_dtw_prefix@k and
    mutual_knn_dtw_prefix@k. `target` is the queries' neighbour table within the corpus; one narrower than needed raises."""
    width, need = _width(target), max(topks)
    if width < need:
        raise ValueError(f"the neighbour table has {width} columns, {need} are needed")
    missing = queries.join(target.select("clip_idx").distinct(), "clip_idx", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} queries are not in the neighbour table")
    ids = queries.select("clip_idx")
    rows, columns = queries.count(), corpus.count()
    model = topk.cosine_against(queries, corpus, max([*ks, need])).persist()
    _require_neighbours(model, queries, need)
    table = target.join(ids, "clip_idx", "left_semi").persist()
    out = _recalls(model, table, queries, ks, min(relevance, width), f"{prefix}_")
    for k in topks:
        out[f"cknna_dtw_{prefix}@{k}"] = metrics.pool_cknna(model, table, k, rows, columns).first()[0]
        out[f"mutual_knn_dtw_{prefix}@{k}"] = metrics.mutual_knn(model, table, k, rows).first()[0]
    model.unpersist()
    table.unpersist()
    return out


def health(vectors: DataFrame) -> dict[str, float]:
    o = metrics.off_diagonal_of(vectors).first()
    return {"z_std": metrics.z_std(vectors).first()[0], "z_effective_rank": metrics.effective_rank(vectors), "z_off_diag_mean": o.off_diag_mean, "z_off_diag_std": o.off_diag_std}
