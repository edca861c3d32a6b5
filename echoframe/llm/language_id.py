"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams, n = 1 to 3, that
both hold, over the geometric mean of their own numbers. Nyström landmarks turn it into finite
features, on which one-versus-rest kernel ridge regression is fitted. As the landmarks' kernels are sums over
n-grams, landmarks and regression fold into one weight per n-gram and language, and
a batch of texts is scored by the product of its sparse presence matrix with these weights.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Letters are folded to classes 1-63; all else is 0, and runs of it count once.
CLASSES = 64
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
#: Rows that the classifier is fitted on at most, over all languages, and landmarks among them.
SAMPLE, LANDMARKS, RIDGE = 1200, 120, 0.05
#: Rows of a batch that are read into Python at a time.
ROWS = 1000
#: Slope of the softmax that turns responses into scores.
SHARP = 3
_letter = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: a-z keep a class each; other letters share the rest by a multiplicative hash."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if 97 <= c <= 122:
            table[c] = c - 96
        elif chr(c).isalpha():
            table[c] = 27 + ((c * 2654435761) >> 16) % 37
    return table


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the n-grams that a text holds; `seen` is all false before and after."""
    x = _classes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate(([0], x, [0])).astype(np.int32)
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    two = x[:-1] * CLASSES + x[1:]
    three = two[:-1] * CLASSES + x[2:]
    seen[x] = seen[two + CLASSES] = seen[three + CLASSES + CLASSES**2] = True
    ids = np.flatnonzero(seen)
    seen[ids] = False
    return ids


def _has_letter(text: str | None) -> bool:
    return bool(text) and _letter.search(text) is not None and any(map(str.isalpha, text))


def sample_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn, size: int) -> DataFrame:
    """(lang, text) of up to `size` rows that `learn` allows, the same number for each language, taken in hash
    order of the id. Ids are chosen before any text is read."""
    names = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), learn.alias("_learn")).where("_learn and _lang is not null")
    langs = max(1, names.select("_lang").distinct().count())
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = names.select("_id", "_lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, size // langs)).select("_id", "_lang").distinct()
    return names.join(F.broadcast(chosen), ["_id", "_lang"])  # `size` bounds the broadcast


def fit(docs: DataFrame, learn, id_col="doc_id", text_col="text", lang_col="lang", size: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, n-gram numbers, weights): the weights of each kept n-gram for each language."""

    def grams(batches):
        seen = np.zeros(GRAMS, bool)
        for b in batches:
            rows = [(i, lang, presence(t, seen)) for i, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if _has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["id", "lang", "grams"])

    # One row, of at most GRAMS numbers, for each chosen id and language comes to the driver: `size`, or one a language.
    got = sorted((r.lang, r.id, r.grams) for r in sample_rows(docs, id_col, text_col, lang_col, learn, size).select("_id", "_lang", "_text").mapInArrow(grams, "id string, lang string, grams array<int>").groupBy("id", "lang").agg(F.min("grams").alias("grams")).collect())
    langs = sorted({g[0] for g in got})
    if not langs:
        return [], np.zeros(0, np.int64), np.zeros((0, 0))
    kept = np.unique(np.concatenate([g[2] for g in got]))
    rows = np.zeros((len(got), len(kept)), np.float32)
    for row, g in zip(rows, got, strict=True):
        row[np.searchsorted(kept, g[2])] = 1
    rows /= np.sqrt(rows.sum(1, keepdims=True))
    target = np.array([[1.0 if g[0] == lang else -1.0 for lang in langs] for g in got])
    marks = rows[np.linspace(0, len(got) - 1, min(landmarks, len(got))).round().astype(int)]  # rows are in order of language
    near = (rows @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    use = values > 1e-8 * values[-1]
    nystrom = vectors[:, use] / np.sqrt(values[use])
    phi = np.hstack([near @ nystrom, np.ones((len(got), 1))])
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-6
    weight = 1 / np.array([sum(x[0] == g[0] for x in got) for g in got])[:, None]  # languages count alike
    beta = np.linalg.solve(phi.T @ (phi * weight) * (len(got) / len(langs)) + penalty * len(got) / 100, phi.T @ (target * weight) * (len(got) / len(langs)))
    per_gram = marks.T.astype(np.float64) @ (nystrom @ beta[:-1])
    return langs, kept, np.vstack([per_gram, beta[-1:]])


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _predictor(docs: DataFrame, learn, id_col: str, text_col: str, lang_col: str, size: int):
    """A function from texts to (languages, scores), for use on executors, and whether any language was learned."""
    langs, kept, weights = fit(docs, learn, id_col, text_col, lang_col, size)
    table = np.zeros((GRAMS, len(langs)), np.float32)
    if langs:
        table[kept] = weights[:-1]
    # A weight for each n-gram class and language: bounded by the number of languages.
    model = docs.sparkSession.sparkContext.broadcast((langs, table, weights[-1] if langs else None))

    def predict(texts: list, seen: np.ndarray) -> tuple[list[str], list[float]]:
        langs, table, bias = model.value
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if langs and _has_letter(t)]
        for k in range(0, len(at), 64):
            some = at[k : k + 64]
            sets = [presence(texts[i], seen) for i in some]
            starts = np.cumsum([0, *map(len, sets)])[:-1]
            # The sparse presence matrix times the weights.
            f = np.add.reduceat(table[np.concatenate(sets)], starts, axis=0, dtype=np.float64) / np.sqrt([[len(s)] for s in sets]) + bias
            p = np.exp(SHARP * (f - f.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for i, j, row in zip(some, f.argmax(1), p, strict=True):
                pred[i], score[i] = langs[j], float(row[j])
        return pred, score

    return predict, bool(langs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, whether its label was kept from learning, the predicted language, a score.

    Learns from rows whose crc32(id as text) mod 5 is not 0 and whose lang is not null, `size` of them at most;
    predictions see the text alone. Null text and text without a letter give `und` with score 0, as does every
    row where there is nothing to learn from. A null id counts as held out. Ties go to the language that sorts
    first. The score is a softmax over the languages' responses. Other columns are not read. One narrow pass
    after the fit; memory is bounded by a batch and the weights.
    """
    common.ship(docs.sparkSession)
    out = F.coalesce(held_out(id_col), F.lit(True))
    predict, _ = _predictor(docs, ~out, id_col, text_col, lang_col, size)

    def run(batches):
        seen = np.zeros(GRAMS, bool)
        for b in batches:
            pred, score = predict(b.column(2).to_pylist(), seen)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), out, F.col(text_col).cast("string")).mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text is in a language that was learned, with all their columns: rejected are
    null texts and texts without a letter, and only these where there is nothing to learn from. One narrow pass after the fit."""
    common.ship(docs.sparkSession)
    predict, learned = _predictor(docs, F.coalesce(~held_out(id_col), F.lit(False)), id_col, text_col, lang_col, size)
    at = docs.columns.index(text_col)

    def run(batches):
        seen = np.zeros(GRAMS, bool)
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                texts = b.column(at).to_pylist()
                keep = [p != "und" for p in predict(texts, seen)[0]] if learned else [_has_letter(t) for t in texts]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
