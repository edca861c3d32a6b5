"""Similarity join of documents on word shingles, by a grouped prefix join.

A document is the set of its distinct 5-word shingles. Shingles are ordered from rare to frequent; two sets whose
Jaccard similarity reaches t share a shingle among the first n - ceil(t * n) + 1 of each. As shingles
that one document alone holds come first, only documents that share more than a share t of themselves have anything to
join. Equal sets are one node; nodes with the same prefix and size are one group; groups meet over
prefix shingles, pairs of groups are filtered by size, and their members verified.

Only components are wanted, so links inside a component need not all be found: rounds of verification against one
pivot for each prefix shingle come first, and then every remaining pair of nodes that share a prefix shingle but
not yet a component is verified, if places in their prefixes and signatures (parities of their shared shingles) allow a
link. No pair of a component's members is built once they are connected.

How the counts are made: a pass over the texts writes, for each block of documents and each range of shingle
hashes, the sorted hashes with the numbers of their documents. A range is gathered in one task, which
counts every shingle and sends those of two documents or more back to their blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connect

WORDS, PERCENT, PIVOT_ROUNDS = 5, 80, 3
#: Bytes of text in a block.
BLOCK_BYTES = 24 << 20
#: Bits of a shingle's hash that are kept.
BITS = 50
#: Rows of a block's documents that pass the ranges of shingles together.
TOGETHER = 100
#: Tasks over which the postings of one shingle are dealt.
SALTS = 8


def shingle_sequence(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's shingles in order: of the whole sequence if it has fewer words, none if it has none."""
    found = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h >> np.uint64(64 - BITS)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_sequence(text, words))


def needed(n, percent: int = PERCENT):
    return -(-percent * n // 100)


_SPREAD = "bucket int, block long, data binary, at int, doc_id long, n int, node binary"


def _spread(buckets: int, block_bytes: int):
    names = [f.split()[0] for f in _SPREAD.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def rows(block, **columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array([block] * n if k == "block" else columns[k], t) if k in columns or k == "block" else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names=names)

    def flush(block, ids, sets):
        n = np.array([len(s) for s in sets], np.int64)
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        for k in range(0, len(ids), 5000):
            j = slice(k, k + 5000)
            yield rows(block, bucket=[-1 - i // TOGETHER for i in range(len(ids))[j]], at=list(range(k, k + len(ids[j]))), doc_id=ids[j], n=n[j], node=nodes[j])
        h, at = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), n)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        bucket = (h >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)])) if len(h) else np.zeros(1, int)
        out, size = [], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            data = _pack(h[a:b], at[a:b])
            out.append((int(bucket[a]), data))
            size += len(data)
            if size > 4 << 20:
                yield rows(block, bucket=[x[0] for x in out], data=[x[1] for x in out])
                out, size = [], 0
        if out:
            yield rows(block, bucket=[x[0] for x in out], data=[x[1] for x in out])

    def run(batches):
        block, ids, sets, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text))
                size += len(text or "") + 200
                if size > block_bytes:
                    yield from flush(block, ids, sets)
                    block, ids, sets, size = block + 1, [], [], 0
        if ids:
            yield from flush(block, ids, sets)

    return run


def _pack(h: np.ndarray, at: np.ndarray) -> bytes:
    """First hash, differences in 4 bytes (8 where one is larger), then the documents' numbers in 2 (or 4)."""
    d = np.diff(h)
    wide, many = bool(d.max(initial=0) >= 1 << 32), bool(at.max(initial=0) >= 1 << 16)
    return bytes([int(wide), int(many)]) + len(h).to_bytes(4, "little") + h[:1].tobytes() + d.astype(np.uint64 if wide else np.uint32).tobytes() + at.astype(np.uint32 if many else np.uint16).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, kind, at = int.from_bytes(data[2:6], "little"), np.uint64 if data[0] else np.uint32, np.uint32 if data[1] else np.uint16
    first = np.frombuffer(data, np.uint64, 1, 6)
    d = np.frombuffer(data, kind, n - 1, 14).astype(np.uint64)
    return np.cumsum(np.concatenate((first, d))), np.frombuffer(data, at, n, 14 + d.size * kind().itemsize).astype(np.uint32)


_SHARED = "block long, data binary, at int, doc_id long, n int, node binary"
_ENTRY = np.dtype([("h", np.uint64), ("at", np.uint32), ("df", np.uint16)])


def _count(batches):
    """Of each range of hashes: those that two documents or more hold, with that number, back to their blocks."""
    names = [f.split()[0] for f in _SHARED.split(", ")]
    bucket, blocks, parts = None, [], []

    def flush():
        if parts:
            h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            order = np.argsort(h, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
            df = np.empty(len(h), np.int64)
            df[order] = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
            keep = df > 1
            entries = np.empty(int(keep.sum()), _ENTRY)
            entries["h"], entries["at"], entries["df"] = h[keep], at[keep], np.minimum(df[keep], 65535)
            ends = np.cumsum(np.bincount(of[keep], minlength=len(parts)))
            data = [entries[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
            some = [i for i, d in enumerate(data) if d]
            for k in range(0, len(some), 50):
                j = some[k : k + 50]
                yield pa.RecordBatch.from_arrays([pa.array([blocks[i] for i in j], pa.int64()), pa.array([data[i] for i in j], pa.binary()), pa.nulls(len(j), pa.int32()), pa.nulls(len(j), pa.int64()), pa.nulls(len(j), pa.int32()), pa.nulls(len(j), pa.binary())], names=names)

    for b in batches:
        documents = np.asarray(b.column(0)) < 0
        if documents.any():
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(documents)).columns[1:], names=names)
        for k, block, data in zip(*(c.to_pylist() for c in b.filter(pa.array(~documents)).columns[:3]), strict=True):
            if k != bucket:
                yield from flush()
                bucket, blocks, parts = k, [], []
            blocks.append(block)
            parts.append(_unpack(data))
    yield from flush()


_SETS = "doc_id long, n int, node binary, first int, shared array<long>, sig array<long>"
#: Longs in a signature, whose bits are the parities of the shared shingles that fall on them.
SIGNATURE = 8


def _signature(h: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount(h & (64 * SIGNATURE - 1), minlength=64 * SIGNATURE) & 1).view(np.int64)


def _gather(percent: int):
    """Of each block: its documents, with their shared shingles from rare to frequent where the prefix holds any."""

    def flush(documents, parts):
        documents = [d[1:] for d in sorted(documents, key=lambda d: d[0])]
        n = np.array([d[1] for d in documents], np.int64)
        e = np.concatenate([np.frombuffer(p, _ENTRY) for p in parts]) if parts else np.zeros(0, _ENTRY)
        e = e[np.lexsort((e["h"], e["df"], e["at"]))]
        held = np.bincount(e["at"], minlength=len(n))
        ends = np.cumsum(held)
        # The prefix less the shingles that no other document holds.
        first = np.minimum(n - needed(n, percent) + 1 - (n - held), held)
        h = e["h"].astype(np.int64)
        for k in range(0, len(n), 500):
            j = range(k, min(k + 500, len(n)))
            shared = [h[ends[i] - held[i] : ends[i]] if first[i] > 0 else None for i in j]
            sig = [None if x is None else _signature(x) for x in shared]
            yield pa.RecordBatch.from_arrays([pa.array([documents[i][0] for i in j], pa.int64()), pa.array(n[j], pa.int32()), pa.array([documents[i][2] for i in j], pa.binary()), pa.array(np.maximum(first[j], 0), pa.int32()), pa.array(shared, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "first", "shared", "sig"])

    def run(batches):
        block, documents, parts = None, [], []
        for b in batches:
            for of, data, at, doc_id, n, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != block:
                    if documents:
                        yield from flush(documents, parts)
                    block, documents, parts = of, [], []
                if data is None:
                    documents.append((at, doc_id, n, node))
                else:
                    parts.append(data)
        if documents:
            yield from flush(documents, parts)

    return run


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n (its shingles), node (digest of its set), `first` (shared shingles in
    its prefix) and, where there are any, all its shared shingles from rare to frequent."""
    spark = docs.sparkSession
    common.ship(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    spread = rows.mapInArrow(_spread(buckets, block_bytes), _SPREAD).withColumn("to", F.when(F.col("bucket") < 0, F.hash("block", "bucket")).otherwise(F.col("bucket")))
    spread = spread.repartition("to").sortWithinPartitions("bucket").drop("to")
    back = spread.mapInArrow(_count, _SHARED)
    return back.repartition("block").sortWithinPartitions("block").mapInArrow(_gather(percent), _SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with `linked`: whether their sets are similar enough. Shingles that one document alone holds
    are in no intersection, so the shared ones do."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", (100 * both >= percent * (F.col("na") + F.col("nb") - both)).alias("linked"))


def components(rows: DataFrame, percent: int = PERCENT, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(node, component_id) from the rows of shingle_sets(), materialized by the caller."""
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    sets = common.materialize_bucketed(rows.where("first > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("first").alias("first"), F.any_value("shared").alias("shared"), F.any_value("sig").alias("sig")), "join-sets", "node")
    prefix = F.slice("shared", 1, F.col("first"))
    group = F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), "n", F.size("shared"), prefix)), 16, "0") for i in (1, 2))))
    # `s` counts a node's shared shingles; groups also agree in it.
    grouped = sets.select("node", "n", F.size("shared").alias("s"), group.alias("gid"), prefix.alias("prefix"), "sig")
    members = common.materialize(grouped.select("node", "n", "s", "gid", "sig"), "join-members")
    groups = common.materialize(grouped.groupBy("gid").agg(F.any_value("n").alias("n"), F.any_value("s").alias("s"), F.any_value("prefix").alias("prefix")), "join-groups")
    postings = groups.select("gid", "n", "s", F.posexplode("prefix").alias("at", "tok"))
    labels = members.select("node", F.col("node").alias("comp"))
    tested = None

    def near(n1, s1, at1, n2, s2, at2):
        """Whether two nodes whose first common shingle stands at these places among their shared ones can be similar enough."""
        both = F.least(s1 - at1, s2 - at2)
        return 100 * both >= percent * (n1 + n2 - both)

    def close(n1, s1, sig1, n2, s2, sig2):
        """Whether two sets can differ in as few shingles as similar ones do: they differ in those that they hold alone, and in
        one at least for each bit of their signatures that differs."""
        bits = sum((F.bit_count(F.get(sig1, F.lit(i)).bitwiseXOR(F.get(sig2, F.lit(i)))) for i in range(1, SIGNATURE)), F.bit_count(F.get(sig1, F.lit(0)).bitwiseXOR(F.get(sig2, F.lit(0)))))
        return (100 + percent) * (n1 - s1 + n2 - s2 + bits) <= (100 - percent) * (n1 + n2)

    def test(pairs):
        nonlocal labels, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        found = common.materialize(_verified(pairs, sets, percent), "join-tested")
        tested = found.select("a", "b") if tested is None else tested.unionByName(found.select("a", "b"))
        labels = connect(labels, found.where("linked").select("a", "b"))

    def split(placed):
        """Prefix shingles over more than one component, with the least key among their nodes and that node's place of the
        shingle. Groups meet their facts before shingles are listed, and only numbers travel by shingle."""
        comp = F.xxhash64("comp")
        g = placed.groupBy("gid").agg(F.min(comp).alias("lo"), F.max(comp).alias("hi"), F.min("key").alias("key"))
        at = groups.join(g, "gid").select("lo", "hi", "key", F.posexplode("prefix").alias("at", "tok"))
        return at.groupBy("tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("key").alias("key"), F.min_by("at", "key").alias("pat")).where("lo != hi").drop("lo", "hi")

    def by_shingle(some):
        """Postings with the row of `some` for their shingle; a frequent shingle is dealt over SALTS tasks."""
        salted = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return postings.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int")).join(salted, ["tok", "salt"]).drop("salt")

    for i in range(pivot_rounds):
        # A pivot shares much of itself; after the first round, with a random half of the nodes before the others.
        half = F.lit(0) if i == 0 else F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2))
        alone = F.floor((1 - F.col("s") / F.col("n")) * (1 << 14)).cast("long")
        key = F.shiftleft(half.cast("long"), 62) + F.shiftleft(alone, 47) + F.shiftrightunsigned(F.xxhash64("node"), 17)
        placed = members.join(labels, "node").withColumn("key", key)
        pivots = placed.groupBy("key").agg(F.min(F.struct(F.col("node").alias("a"), F.col("comp").alias("acomp"), F.col("sig").alias("asig"), F.col("n").alias("pn"), F.col("s").alias("ps"))).alias("p")).select("key", "p.*")
        open_tokens = split(placed).join(pivots.select("key", "pn", "ps"), "key")
        met = by_shingle(open_tokens).where(near(*map(F.col, ("n", "s", "at", "pn", "ps", "pat")))).select("gid", "key").distinct()
        pairs = met.join(placed.drop("key"), "gid").join(pivots, "key").where((F.col("comp") != F.col("acomp")) & close(*map(F.col, ("n", "s", "sig", "pn", "ps", "asig"))))
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = common.materialize(pairs, "join-pairs")
        if pairs.isEmpty():
            break
        test(pairs)
    # All pairs of nodes over a prefix shingle that are not in one component by now. On one side stand the
    # nodes outside the shingle's largest component.
    placed = members.join(labels, "node").withColumn("key", F.lit(0).cast("long"))
    there = common.materialize(by_shingle(split(placed).select("tok")).join(placed.select("gid", "node", "comp", "sig"), "gid").drop("gid"), "join-open")
    if not there.isEmpty():
        largest = there.groupBy("tok", "comp").count().groupBy("tok").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        few = there.join(largest, "tok").where("comp != main").select("tok", *(F.col(c).alias(f"x{c}") for c in ("node", "comp", "n", "s", "at", "sig"))).withColumnRenamed("xnode", "x")
        test(few.join(there, "tok").where((F.col("xcomp") != F.col("comp")) & near(*map(F.col, ("n", "s", "at", "xn", "xs", "xat"))) & close(*map(F.col, ("n", "s", "sig", "xn", "xs", "xsig")))).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())
    named = labels.join(least, "node")
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    joined = named.join(ids, "comp").select(F.col("node").alias("of"), "component_id")
    return least.join(joined, least["node"] == joined["of"], "left").select("node", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest id reachable over links.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. Null text and text
    without words have the empty set, link with nothing and are their own component (null for a null id);
    fewer words than a shingle has make one shingle. Repeated rows and equal sets are one node. Null ids
    count in no minimum. Other columns are not read; an empty table gives none.

    Shingles are compared by 50 bits of their hash: two documents of a thousand shingles each have
    one in common by chance once in 10**9 pairs.
    """
    rows = common.materialize(shingle_sets(docs, id_col, text_col, percent, block_bytes), "join-rows")
    found = components(rows.where("n > 0"), percent)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n", "node").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is their component's, with all their columns; rows that repeat such an id all stay, as
    do rows without an id whose component has none."""
    found = near_duplicates(docs, id_col, text_col, percent)
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))  # noqa: E731  no id reads as the empty string
    keep = found.where("doc_id <=> component_id").select(key(F.col("doc_id")).alias("id")).distinct()
    rows = docs.select(key(F.col(id_col).cast("long")).alias("id"), F.struct("*").alias("row"))
    return rows.join(keep, "id", "left_semi").select("row.*")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
