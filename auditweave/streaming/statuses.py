"""Review statuses aged in the state of a stream: set by readers, handed to stable ids, orphaned and removed by timers.

Events are keyed by item id (JSON files, `kind`):

* status: a reader set `status` at `ts`; `unreviewed` removes it.
* item: an index run at `ts` found an item; its `legacy_ids` hand their status to it.
* run: the end of a run over the whole workspace, written after its items. Only these move the watermark, so nothing is
  orphaned by a run over some files, nor before all of a run's items are read.

A status has a timer just after it was last seen. It fires once a later run has ended: the item is missing there and becomes
an orphan, with a second timer for when the retention is over. An item that comes back resets both. A legacy id gives its
record away as an offer, which the stream reads back as an event of the stable id; offers meet in the order of the item's
legacy ids, and one that has a status keeps it.

The state lies in RocksDB. Results are what `state.reconcile` gives for the same runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditweave import catalog

EVENT = "kind string, item_id string, status string, ts timestamp, legacy_ids array<string>, n int, seen timestamp"
OUT = "item_id string, action string, status string, updated_at long, orphaned_at long, to_id string, n int, seen long"
RECORD = "status string, updated_at long, orphaned_at long, seen long"
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400_000
ORDER = {"status": 0, "legacy": 1, "item": 2, "offer": 3}


class Aging(StatefulProcessor):
    """One item's record; times are milliseconds."""

    def __init__(self, retention_days: int = catalog.RETENTION_DAYS):
        self.retention = retention_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.record = handle, handle.getValueState("record", RECORD)

    def _time(self, at: int | None) -> None:
        """At most one timer a record: just after it was seen, or for the end of its retention."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        record = self.record.get()
        held = dict(zip(("status", "updated_at", "orphaned_at", "seen"), record)) if record else None
        before, out, action = dict(held) if held else None, None, "kept"
        for r in sorted(rows, key=lambda r: (r.at or 0, ORDER.get(r.kind, 9), r.n or 0)):
            if r.kind == "status":
                held = None if r.status == "unreviewed" else {"status": r.status, "updated_at": r.at, "orphaned_at": None, "seen": r.at}
                action = "kept" if held else "removed"
            elif r.kind == "legacy" and held:
                out = Row(item_id=key[0], action="moved", status=held["status"], updated_at=held["updated_at"], orphaned_at=None, to_id=r.to_id, n=r.n, seen=r.at)
                held = None
            elif r.kind == "item" and held:
                held |= {"orphaned_at": None, "seen": max(r.at, held["seen"])}
            elif r.kind == "offer" and not held:
                held, action = {"status": r.status, "updated_at": r.at, "orphaned_at": None, "seen": r.seen}, "migrated"
        if held != before:
            if held:
                self.record.update(tuple(held.values()))
                self._time(held["seen"] + 1)
            else:
                self.record.clear()
                self._time(None)
        if out is not None:
            yield out
        elif held != before or action == "migrated":
            last = held or before
            yield Row(item_id=key[0], action=action, status=last["status"], updated_at=last["updated_at"], orphaned_at=last["orphaned_at"], to_id=None, n=None, seen=last["seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        record, now = self.record.get(), timerValues.getCurrentWatermarkInMs()
        if not record:
            return
        status, updated_at, orphaned_at, seen = record
        if orphaned_at is None and seen >= now:
            self._time(seen + 1)
            return
        if orphaned_at is None:
            action, orphaned_at = "orphaned", now
        elif now - orphaned_at >= self.retention:
            action = "removed"
        else:
            self._time(orphaned_at + self.retention - 1)
            return
        if action == "orphaned":
            self.record.update((status, updated_at, orphaned_at, seen))
            self._time(orphaned_at + self.retention - 1)
        else:
            self.record.clear()
        yield Row(item_id=key[0], action=action, status=status, updated_at=updated_at, orphaned_at=orphaned_at, to_id=None, n=None, seen=seen)

    def close(self) -> None:
        pass


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of status, item, run and offer events from a folder of JSON files."""
    return spark.readStream.schema(EVENT).json(folder)


def keyed(stream: DataFrame) -> DataFrame:
    """Events by the id they concern: an item's also by each of its legacy ids. mark: the ends of whole runs, for the watermark."""
    legacy = F.transform(F.coalesce("legacy_ids", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("legacy").alias("kind"), x.alias("item_id"), F.col("item_id").alias("to_id"), i.cast("int").alias("n")))
    own = F.struct("kind", F.coalesce("item_id", F.lit("")).alias("item_id"), F.lit(None).cast("string").alias("to_id"), F.col("n"))
    rows = stream.select("status", "ts", "seen", F.when(F.col("kind") == "run", F.col("ts")).alias("mark"), F.explode(F.when(F.col("kind") == "item", F.concat(F.array(own), legacy)).otherwise(F.array(own))).alias("e"))
    return rows.select("e.item_id", "e.kind", "e.to_id", "e.n", "status", F.unix_millis("ts").alias("at"), F.unix_millis("seen").alias("seen"), "mark").withWatermark("mark", "0 seconds")


def aged(stream: DataFrame, retention_days: int = catalog.RETENTION_DAYS) -> DataFrame:
    """What happened to each status: item_id, action (kept, moved, migrated, orphaned, removed), status and its times."""
    return keyed(stream).groupBy("item_id").transformWithState(Aging(retention_days), OUT, "Update", "EventTime")


class Statuses:
    """A folder of events in, a log of actions out; current is the statuses of now."""

    def __init__(self, spark: SparkSession, inbox: str, folder: str, retention_days: int = catalog.RETENTION_DAYS):
        self.spark, self.inbox, self.folder, self.retention_days = spark, inbox.rstrip("/"), folder.rstrip("/"), retention_days
        self.offered = False

    def _each(self, batch: DataFrame, number: int) -> None:
        path = f"{self.folder}/actions/{number}"
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(path)
        moved = self.spark.read.parquet(path).where("action = 'moved'")
        if not moved.isEmpty():
            # a name of its own a batch, so a batch that is tried again offers nothing twice that counts
            offers = moved.select(F.lit("offer").alias("kind"), F.col("to_id").alias("item_id"), "status", F.timestamp_millis("updated_at").alias("ts"), "n", F.timestamp_millis("seen").alias("seen"))
            offers.write.mode("overwrite").json(f"{self.folder}/offers/{number}")
            self.offered = True

    def run(self) -> None:
        """Reads what has come, and what it led to, until nothing is left."""
        old = {k: self.spark.conf.get(k, None) for k in ROCKSDB}
        while True:
            self.offered = False
            try:
                for k, v in ROCKSDB.items():
                    self.spark.conf.set(k, v)
                both = events(self.spark, self.inbox).unionByName(events(self.spark, f"{self.folder}/offers/*"))
                query = aged(both, self.retention_days).writeStream.outputMode("update").foreachBatch(self._each).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
            finally:
                for k, v in old.items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
            query.awaitTermination()
            if not self.offered:
                return

    @property
    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/actions/*").withColumns({"updated_at": F.timestamp_millis("updated_at"), "orphaned_at": F.timestamp_millis("orphaned_at")})

    @property
    def current(self) -> DataFrame:
        """item_id, status, updated_at, orphaned_at: each item's last record that wasn't moved or removed."""
        last = self.log.withColumn("_k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("batch")))).where("_k = 1")
        return last.where("action not in ('moved', 'removed')").select("item_id", "status", "updated_at", "orphaned_at")
