"""Exact deduplication by Grace hashing.

Records are partitioned by their content's hash: first Spark's exchange deals them to partitions, then a task whose
partition does not fit an open-addressing table deals it to spill files by the next four bits of the
digest, and each file again until one fits. The table compares complete contents. Before the
exchange the same table collapses the copies that a task meets, so a group of any size sends a row per table and task.

Spill files are nameless, hold what one task alone reads back, and end with it: a lost executor costs the tasks
it ran, as with Spark's own spilled sorts. Nothing that another process reads lies in them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of content that a table may hold.
BUDGET = 32 << 20
#: Spill files that a bucket is dealt to: one for each value of four bits of the digest.
FANOUT = 16
_ROWS = "digest binary, text string, keep_id long, n long"
_SPILL = pa.schema([("digest", pa.binary()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])


class ContentTable:
    """Open addressing with linear probing; equal means equal in every character."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots, self.digests, self.texts, self.keep, self.n, self.bytes = [-1] * 1024, [], [], [], [], 0

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for k, d in enumerate(self.digests):
            self.slots[self._free(d)] = k

    def _free(self, digest: bytes) -> int:
        at, mask = int.from_bytes(digest[-8:], "little"), len(self.slots) - 1
        while self.slots[at & mask] >= 0:
            at += 1
        return at & mask

    def add(self, digest: bytes, text: str, doc_id: int | None, n: int) -> bool:
        """Counts a record; tells whether another content of its digest stands in the table."""
        at, mask, clash = int.from_bytes(digest[-8:], "little"), len(self.slots) - 1, False
        while (k := self.slots[at & mask]) >= 0:
            if self.digests[k] == digest:
                if self.texts[k] == text:
                    self.n[k] += n
                    if doc_id is not None and (self.keep[k] is None or doc_id > self.keep[k]):
                        self.keep[k] = doc_id
                    return clash
                clash = True
            at += 1
        self.slots[at & mask] = len(self.texts)
        for column, x in ((self.digests, digest), (self.texts, text), (self.keep, doc_id), (self.n, n)):
            column.append(x)
        self.bytes += 2 * len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return clash

    def batches(self, with_text: bool):
        for i in range(0, len(self.texts), 2000):
            j = slice(i, i + 2000)
            texts = pa.array(self.texts[j] if with_text else [None] * len(self.texts[j]), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(self.digests[j], pa.binary()), texts, pa.array(self.keep[j], pa.int64()), pa.array(self.n[j], pa.int64())], names=["digest", "text", "keep_id", "n"])


def _collapse(with_text: bool, whole: bool, budget: int):
    """A pass over a partition: `whole` gives one row for each content, else one for each content and table."""

    def run(batches):
        if whole:
            yield from _bucket(batches, 0, with_text, budget)
            return
        table = ContentTable()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if table.bytes > budget:
                    yield from table.batches(with_text)
                    table.clear()
                table.add(*row)
        yield from table.batches(with_text)

    return run


def _bucket(batches: Iterable[pa.RecordBatch], level: int, with_text: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """The contents of a bucket whose digests agree in their first `level` groups of four bits. One content alone is
    a bucket that fits, as no dealing makes it smaller; two digests differ at some level, so dealing ends."""
    batches, table = iter(batches), ContentTable()
    for b in batches:
        for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if table.add(*row):
                raise RuntimeError("two texts share a SHA-256")
            if table.bytes > budget and len(table.texts) > 1:
                yield from _dealt(table, b.slice(i + 1), batches, level, with_text, budget)
                return
    yield from table.batches(with_text)


def _dealt(table: ContentTable, part: pa.RecordBatch, batches: Iterator[pa.RecordBatch], level: int, with_text: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """A bucket by way of spill files: what its table holds, the rest of a batch and the batches to come."""

    def rows():
        yield from table.batches(True)
        table.clear()
        yield part
        yield from batches

    with ExitStack() as open_:
        files = [open_.enter_context(tempfile.TemporaryFile()) for _ in range(FANOUT)]
        writers = [pa.ipc.new_stream(f, _SPILL, options=pa.ipc.IpcWriteOptions(compression="lz4")) for f in files]
        for b in rows():
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, _SPILL.types, strict=True)], schema=_SPILL)
            byte = np.frombuffer(bytes(d[level // 2] for d in b.column(0).to_pylist()), np.uint8)
            to = byte & 15 if level % 2 else byte >> 4
            for k in np.unique(to):
                writers[k].write_batch(b.take(pa.array(np.flatnonzero(to == k))))
        for w in writers:
            w.close()
        for f in files:
            f.seek(0)
            yield from _bucket(pa.ipc.open_stream(f), level + 1, with_text, budget)
            f.close()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per distinct text: digest (SHA-256), keep_id (the largest id) and group_size."""
    common.ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"), F.col(id_col).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    local = rows.mapInArrow(_collapse(True, False, budget), _ROWS)
    return local.repartition("digest").mapInArrow(_collapse(False, True, budget), _ROWS).select("digest", "keep_id", F.col("n").alias("group_size"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: the id of the row of its text that stays, the size of its group, whether
    it is the one, and the digest of its text.

    Null text equals empty text. Of a group the largest id stays; null ids stay only where a group has no
    other (keep_id is then null). Rows that repeat an id and its text all count in group_size
    and all carry kept; `deduplicate` leaves one of them. Other columns are not read. An empty table gives none.

    The last join is by digest, after contents have been compared whole: two contents of one digest
    end the job with an error. Copies of a hot text are a row per task before the exchange,
    and the join by digest is an equi-join that adaptive execution splits.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    found = classes(docs, id_col, text_col, budget)
    return ids.join(found, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with all their columns.

    Rows that repeat an id and a text meet in the join's own partitions and order, where one of them is left.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))  # noqa: E731  no id reads as the empty string
    found = classes(docs, id_col, text_col, budget).select("digest", key(F.col("keep_id")).alias("id"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), key(F.col(id_col).cast("long")).alias("id"), F.struct("*").alias("row"))
    return rows.join(found.hint("merge"), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"]).select("row.*")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
