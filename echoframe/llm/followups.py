"""Alerts on error clicks that no sale follows within a day, by a stateful streaming query that is started once a batch.

A client's first error click opens an obligation that lasts 24 hours; later ones join it, and a sale ends it. Events
arrive out of order, so they wait in a list (ListState) until the watermark has passed them, and are then taken by client
in order of time; open obligations are a value (ValueState). Event-time timers call for both: one at the earliest
time that waits, to drain the list, and one at the earliest end of an obligation.

A call to the state costs milliseconds in Python and in the JVM whatever it holds, so the key is a shard of clients, by
hash: as many shards as leave each some SHARD events a batch. Clients do not meet within one.

Spark keeps watermarks and timers in milliseconds, and events here are told apart by microseconds. So the query runs on
a clock of its own that has a millisecond for every microsecond since `EPOCH`: a timer at t fires once the watermark is
past t, to the microsecond. The clock's column carries the watermark and is then left out, as Spark would drop late rows
by it: these are counted, not dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from . import common

#: Batches, the hours that they share, the hours by which a quarter of the rows is set back.
BATCHES, HOURS, SHIFT = 8, 3648, 80
#: Microseconds: of an hour, of an obligation, by which the watermark trails, from 1970 to 2024, from 1970 to the clock's start in 1900.
HOUR = 3_600_000_000
OPEN, DELAY, YEAR_2024, EPOCH = 24 * HOUR, 96 * HOUR, 1_704_067_200_000_000, -2_208_988_800_000_000
#: The clock's last tick, of the year 2191, and the reading from which all that is left is drained.
FAR = 9_200_000_000_000_000
END = FAR - DELAY
CLICK, SALE, MARKER = 0, 1, 2
#: What a marker row is for the state: a number that no event has.
NO_EVENT = -(2**63)
#: Events in an element of the list; of a batch in a shard, about.
CHUNK, SHARD = 10_000, 500
EVENTS = "client_id long, kind int, us long, ends boolean"
ALERTS = "client_id long, opened_us long, due_us long, n_rows long"


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp, which is read as UTC where it has no zone."""
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        since = F.col(column) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(24, 6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(column).cast("timestamp"))


def batch_of(df: DataFrame, arrived: str, key: str) -> Column:
    """The batch of a row: whole hours from 2024 on to its arrival, set back by 0 to 3 times SHIFT hours by its id's checksum.
    No arrival time counts as 2024's first hour, no id as no setback; arrivals before 2024 are in batch 0."""
    hours = F.floor((F.coalesce(micros(df, arrived), F.lit(YEAR_2024)) - YEAR_2024) / HOUR)
    back = SHIFT * F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4, F.lit(0))
    return F.least(F.lit(BATCHES - 1), F.greatest(F.lit(0), F.floor((hours + back) * BATCHES / HOURS))).cast("int")


def events(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """(client_id, kind, us, ends, batch): error clicks, rows that are equal in all columns once, and sales, both with client and
    time. `ends` is false for sales that can end nothing: those with no error click of their client on their day or the day
    before, in any batch, found by an equi-join on client and day."""
    day = F.floor(F.col("us") / OPEN)  # an obligation reaches into the next day and no further
    c = clicks.where("kind = 'error'").dropDuplicates()
    c = c.select(F.col("client_id").cast("long").alias("client_id"), F.lit(CLICK).alias("kind"), micros(c, "ts").alias("us"), batch_of(c, "arrived_at", "click_id").alias("batch"))
    c = c.where("client_id IS NOT NULL AND us IS NOT NULL")
    s = sales.select(F.col("client_id").cast("long").alias("client_id"), F.lit(SALE).alias("kind"), micros(sales, "sold_at").alias("us"), batch_of(sales, "arrived_at", "sale_id").alias("batch"))
    s = s.where("client_id IS NOT NULL AND us IS NOT NULL")
    days = c.select("client_id", F.explode(F.array(day, day + 1)).alias("day")).distinct().withColumn("ends", F.lit(True))
    s = s.withColumn("day", day).join(days, ["client_id", "day"], "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    return c.withColumn("ends", F.lit(True)).unionByName(s.drop("day"))


class FollowUps(StatefulProcessor):
    """The state of a shard of clients. An event is 2 * us + kind, so that numbers sort by time, clicks first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "clients array<long>, events array<long>")
        self.obligations = handle.getValueState("obligations", "clients array<long>, opened array<long>, n array<long>")
        self.drained = set()  # shards whose timer has fired in this batch

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        clients, events, late = [], [], []
        for pdf in rows:
            c, e = pdf["client_id"].to_numpy(), pdf["event"].to_numpy()
            real = e != NO_EVENT
            behind = real & (e >> 1 < EPOCH + clock) if clock > 0 else np.zeros(len(e), bool)
            late.append(c[behind])
            clients.append(c[real & ~behind])
            events.append(e[real & ~behind])
        clients, events, late = (np.concatenate(x) for x in (clients, events, late))
        if len(events):
            self.waiting.appendList(_chunks(clients, events))
            self.handle.registerTimer(_clock(int(events.min()) >> 1))
        if len(late):
            clients, n = np.unique(late, return_counts=True)
            yield _told(clients, -1, -1, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Whichever timer fires first in a batch drains all that the watermark has passed; the others find nothing."""
        if key[0] in self.drained:
            return
        self.drained.add(key[0])
        clock = timerValues.getCurrentWatermarkInMs()
        limit = EPOCH + clock if clock < END else float("inf")
        chunks = list(self.waiting.get())
        clients, events = (np.array([x for c in chunks for x in c[k]], np.int64) for k in range(2))
        ripe = events >> 1 < limit
        was = self.obligations.get()
        was = {} if was is None else {c: (opened, n) for c, opened, n in zip(*was, strict=True)}
        passed = ripe_by_client(clients[ripe], events[ripe])
        now, told = {}, []
        for client in was.keys() | passed.keys():
            obligation, alerts = settle(was.get(client), passed.get(client, []), limit)
            if obligation:
                now[client] = obligation
            told += [(client, *alert) for alert in alerts]
        if ripe.all():
            self.waiting.clear()
        else:
            left = events[~ripe]
            if ripe.any():
                self.waiting.put(_chunks(clients[~ripe], left))
            self.handle.registerTimer(_clock(int(left.min()) >> 1))
        if now:
            self.handle.registerTimer(_clock(min(opened for opened, _ in now.values()) + OPEN))
        if not now:
            self.obligations.clear()
        elif now != was:
            self.obligations.update((list(now), [opened for opened, _ in now.values()], [n for _, n in now.values()]))
        if told:
            yield _told(*zip(*told, strict=True))


def ripe_by_client(clients: np.ndarray, events: np.ndarray) -> dict[int, list[int]]:
    """Sorted events of each client."""
    order = np.lexsort((events, clients))
    clients, events = clients[order], events[order]
    begins = np.flatnonzero(np.concatenate(([True], np.diff(clients) != 0))) if len(clients) else []
    return {int(clients[a]): events[a:b].tolist() for a, b in zip(begins, [*begins[1:], len(clients)], strict=True)}


def settle(obligation: tuple[int, int] | None, ripe: list[int], limit: float) -> tuple[tuple[int, int] | None, list[tuple[int, int, int]]]:
    """What becomes of an obligation (opened, clicks) when sorted events pass and time reaches `limit`: the one that is open
    then, and alerts (opened_us, due_us, n_rows)."""
    alerts = []
    for e in ripe:
        us, kind = e >> 1, e & 1
        if obligation and us > obligation[0] + OPEN:
            alerts.append((obligation[0], obligation[0] + OPEN, obligation[1]))
            obligation = None
        if kind == SALE:
            obligation = None
        else:
            obligation = (obligation[0], obligation[1] + 1) if obligation else (us, 1)
    if obligation and obligation[0] + OPEN < limit:
        alerts.append((obligation[0], obligation[0] + OPEN, obligation[1]))
        obligation = None
    return obligation, alerts


def _clock(us: int) -> int:
    return min(max(us - EPOCH, 0), END - 1)


def _chunks(clients: np.ndarray, events: np.ndarray) -> list[tuple[list[int], list[int]]]:
    return [(clients[k : k + CHUNK].tolist(), events[k : k + CHUNK].tolist()) for k in range(0, len(events), CHUNK)]


def _told(clients, opened, due, n) -> pd.DataFrame:
    return pd.DataFrame({"client_id": clients, "opened_us": opened, "due_us": due, "n_rows": n}, dtype="int64")


def _session(spark: SparkSession) -> SparkSession:
    """A session with what the query needs: RocksDB as state store, and one micro-batch for each start. Every start opens the
    stores anew, so tasks close theirs, and stores don't reserve files ahead."""
    own = spark.newSession()
    for k, v in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        own.conf.set(k, v)
    return own


def alerts(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per alert, and one per batch and client with late events: batch, client_id, opened_us, due_us (both -1 for
    late events) and n_rows (the obligation's clicks, or the late events).

    Both tables are cut into BATCHES by arrival and written under the shared folder, and a streaming query is started on
    one checkpoint for each batch in turn. A batch's watermark is the largest event time of the batches before it less 96
    hours; its events before that are late. Clicks come before sales of the same microsecond, and an obligation
    is open through its last microsecond. An alert's batch is the first whose watermark is past due_us, with rows or without:
    every batch has a marker row, which is no event. The last one's is at the end of the clock, so the start that follows the last
    batch finds all time past, and what it tells is batch 8.

    Sales that can end nothing move the watermark and are counted where they are late; of the others they are left out before the
    state.

    Rows without client or time are no events; nor are clicks of another kind or none. Click rows that repeat in all
    columns count once, sales each time. Empty tables give no rows, extra columns are not read, except
    that they tell click rows apart. Times are told apart from 1900 to 2191; what is earlier or later is as at the clock's end.

    State, shuffles and the list of a shard grow with its clients' events in two batches, and shards are as many as the largest
    batch asks for; no row passes the driver. Every call uses new folders.
    """
    spark = clicks.sparkSession
    common.ship(spark)
    own = _session(spark)
    folder = f"{common.shared_dir(spark)}/followups-{uuid.uuid4().hex}"
    marker = spark.range(BATCHES + 1).select(F.lit(0).cast("long").alias("client_id"), F.lit(MARKER).alias("kind"), F.when(F.col("id") == BATCHES - 1, F.lit(EPOCH + FAR)).otherwise(F.lit(EPOCH)).alias("us"), F.lit(True).alias("ends"), F.col("id").cast("int").alias("batch"))
    events(clicks, sales).unionByName(marker).write.partitionBy("batch").parquet(f"{folder}/in")
    clock = F.least(F.greatest(F.col("us") - EPOCH, F.lit(0)), F.lit(FAR))
    # A row for each batch.
    seen = spark.read.schema(f"{EVENTS}, batch int").parquet(f"{folder}/in").groupBy("batch").agg(F.max(clock).alias("at"), F.count_if("ends").alias("n")).collect()
    latest = {r.batch: r.at for r in seen}
    shards = -(-max(r.n for r in seen) // SHARD)
    for b in range(BATCHES + 1):
        mark = max([latest[x] for x in range(b)], default=0) - DELAY
        # The files of this batch are new to the checkpoint; those of earlier ones it has seen.
        arrived = own.readStream.schema(EVENTS).parquet(f"{folder}/in/batch={{{','.join(map(str, range(b + 1)))}}}")
        timed = arrived.withColumn("clock", F.timestamp_millis(clock)).withWatermark("clock", f"{DELAY // 1000} seconds")
        # The condition names the clock, so it stays behind the watermark, which all events move.
        event = F.when(F.col("kind") == MARKER, F.lit(NO_EVENT)).otherwise(2 * F.col("us") + F.col("kind")).alias("event")
        timed = timed.where(F.col("ends") | (F.unix_millis("clock") < mark)).select(F.pmod(F.xxhash64("client_id"), F.lit(shards)).alias("shard"), "client_id", event)
        out = timed.groupBy("shard").transformWithStateInPandas(FollowUps(), ALERTS, "Append", "EventTime").withColumn("batch", F.lit(b))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{ALERTS}, batch int").parquet(f"{folder}/out").select("batch", "client_id", "opened_us", "due_us", "n_rows")
