"""How five text filters act on each other, for every order in which they can be applied.

What a filter removes in an order is decided by a document's mask alone: the set of filters that it fails. So the
texts are read once, and what is left of them is a histogram of 32 masks for each part of the corpus; the
histograms of all documents, of those of good quality and of toxic ones are stacked as rows, and products with
integer matrices of 32 masks by 600 columns (120 orders of 5 steps) give all outcomes at once.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Filters by the bit of the mask that tells that a document fails them.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Fixed values of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
#: Salts that rows without an id are dealt by where labels are joined.
SALTS = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_mask(text: bytes, code_points: int) -> int:
    """The filters that a text fails by itself, E left out; words are cut at ASCII white space alone."""
    words = text.split()
    mask = int(len(words) < LEAST_WORDS)
    mask |= 2 * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
    mask |= 4 * (100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITALS_PERCENT * code_points)
    return mask | 8 * (len(text) != len(text.translate(None, SIGNS)))


def _masks(batches):
    import pyarrow.compute as pc

    for b in batches:
        points = pc.utf8_length(b.column(2)).to_pylist()
        texts = b.column(2).cast(pa.binary()).to_pylist()
        masks = [own_mask(t, n) for t, n in zip(texts, points, strict=True)]
        digests = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])


@lru_cache(maxsize=1)
def outcomes() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The 600 columns as (order, step), and a matrix of 32 masks by 600 columns for each outcome; `own` tells
    which columns have the same filter, whatever the order."""
    columns = [("".join(p), s) for p in permutations(FILTERS) for s in range(1, len(FILTERS) + 1)]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    here = np.array([bit[o[s - 1]] for o, s in columns])
    before = np.array([sum(bit[f] for f in o[: s - 1]) for o, s in columns])
    mask = np.arange(MASKS)[:, None]
    fails, earlier = (mask & here) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": mask == here}
    return columns, {k: v.astype(np.int64) for k, v in found.items()} | {"own": (here[:, None] == here[None]).astype(np.int64)}


def _multiply(batches):
    columns, m = outcomes()
    for b in batches:
        parts = b.column(0).to_pylist()
        rows = np.zeros((3, len(parts), MASKS), np.int64)
        for p, cells in enumerate(b.column(1).to_pylist()):
            for c in cells:
                rows[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
        all_, good, toxic = rows
        removed = all_ @ m["removed"]
        out = {"kept": all_ @ m["kept"], "removed": removed, "redundant": all_ @ m["redundant"], "unique_fails": all_ @ m["unique_fails"], "good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"], "shapley": removed @ m["own"]}
        n = len(columns)
        names = [pa.array(np.repeat(np.array(parts, object), n), pa.string()), pa.array([o for o, _ in columns] * len(parts), pa.string()), pa.array(np.tile(np.array([s for _, s in columns], np.int32), len(parts)))]
        yield pa.RecordBatch.from_arrays([*names, *(pa.array(out[c].ravel()) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the histogram of all documents, of good ones and of toxic ones, by mask."""
    common.ship(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = read.mapInArrow(_masks, "doc_id long, part string, digest binary, mask int")
    # A row for each label of each document would count a document twice: any label that says so counts once.
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = told.where("doc_id IS NOT NULL").withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = rows.withColumn("salt", salt).join(told, ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    # Copies add up before they meet: first by id, then by text, part and labels, which leaves a few rows for each text.
    group = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*group, "doc_id", "salt").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = F.min("first").over(Window.partitionBy("digest"))
    passes = F.when(F.col("first") == least, F.col("n_first")).otherwise(0) + F.col("n_null")
    split = by_text.withColumn("passes", F.coalesce(passes, F.col("n_null")))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + MASKS // 2).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    cells = split.select("part", "good", "toxic", both.alias("c")).select("part", "c.mask", "c.n", "good", "toxic")
    return cells.groupBy("part", "mask").agg(*(F.sum(x).cast("long").alias(c) for x, c in ((F.col("n"), "n"), (F.col("n") * F.col("good"), "good"), (F.col("n") * F.col("toxic"), "toxic"))))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part of the corpus, order of the filters and step.

    Filters, by the condition on which a text fails: A under 100 words; B under 80 % of its words distinct; C over 10 %
    of its code points A-Z; D any of # $ % & * |; E equal to the text of a smaller id, removed or not. Null text is
    empty. Null parts are the part ''. A row without an id has no label, fails E never and makes none fail; rows that
    repeat an id and a text are rows of their own, none of which makes another fail E. Labels that repeat an id count
    once, as told by any of them. Texts are equal when their SHA-256 is. No documents give no rows; empty labels
    give zeros. Other columns are not read.

    Shuffles carry ids and digests; what one text's copies send is a row for each part and label. The histogram of a
    part has 32 rows at most, and the matrices are constants.
    """
    cells = masks(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return cells.mapInArrow(_multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
fails AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM words),
hist AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN told USING (doc_id) GROUP BY part, f),
l AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, l.k AS step FROM orders, l),
marked AS (SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, f[o[step]] AS here, step > 1 AND list_bool_or(list_transform(o[1:step-1], lambda x: f[x])) AS earlier,
   len(list_filter(f, lambda x: x)) = 1 AS single FROM hist, steps),
sums AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
   sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND single THEN n ELSE 0 END) AS unique_fails,
   sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM marked GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
   good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM sums
"""
