"""Live indexing with Structured Streaming: file versions in, last edits out, and a table that is its own log.

The index is log-structured. A batch writes one part with only the rows it changes and commits it by a line in a log
(stream, batch, part, level, the parts it replaces). Reading merges the live parts; FAN_IN parts of one level are merged into
one of the next, so what a batch writes follows its own size, times the logarithm of the corpus at most.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave import catalog
from auditweave.storage import remove, stored

FAN_IN = 4
LOG = "seq long, stream string, batch long, path string, rows long, level int, replaces array<string>"
CHANGE = "absolute_path string, relative_path string, language string, text string, version long, op string, ts timestamp"
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]


def changes(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of editor changes (op: save, create, delete, rename) from a folder of JSON files."""
    reader = spark.readStream.schema(CHANGE)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)


def debounced(stream: DataFrame, gap: str = f"{catalog.DEBOUNCE_MS} milliseconds", late: str = "10 seconds") -> DataFrame:
    """Of every burst of edits of one document the last text; bursts end after `gap` without edits; equal times go to the higher version."""
    w = F.session_window("ts", gap)
    last = F.max_by(F.struct("relative_path", "language", "text", "version", "op"), F.struct("ts", "version")).alias("last")
    return stream.withWatermark("ts", late).groupBy("absolute_path", w).agg(last, F.max("ts").alias("ts")).select("absolute_path", "last.*", "ts")


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each file; ties go to the later change."""
    w = Window.partitionBy(F.lower("absolute_path")).orderBy(F.desc("version"), F.desc("ts"), F.desc("op"), F.desc("text"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


class LiveIndex:
    """The current corpus, changed batch by batch: stale versions are ignored, deletes remove, a failed batch changes nothing.

    Batches are known by their stream (a query's id, which a new checkpoint changes) and their number in it, so one that
    comes again is passed over, and one of another stream is not. An index opened on the same folder, which all executors
    share, goes on where the log ends. rebuild(changed, current) is called with a batch's effective rows and the corpus it
    leads to, before anything is committed.
    """

    def __init__(self, spark: SparkSession, folder: str, rebuild: Callable[[DataFrame, DataFrame], object] | None = None):
        self.spark, self.folder, self.rebuild = spark, folder.rstrip("/"), rebuild
        try:
            rows = sorted(spark.read.schema(LOG).parquet(f"{self.folder}/log").collect(), key=lambda r: r.seq)  # one line a batch or merge
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a log that can't be read is no empty log
                raise
            rows = []
        self.parts: dict[str, tuple[int, int]] = {}  # path -> (level, rows), in order
        self.done: dict[str, int] = {}  # stream -> its last batch
        self.seq = 0
        for r in rows:
            self._take(r.asDict())

    def _take(self, line: dict) -> None:
        for path in line["replaces"] or ():
            self.parts.pop(path, None)
        if line["path"]:
            self.parts[line["path"]] = (line["level"], line["rows"])
        if line["stream"] is not None:
            self.done[line["stream"]] = max(line["batch"], self.done.get(line["stream"], -1))
        self.seq = max(self.seq, line["seq"])

    def _commit(self, **line) -> None:
        line = {"seq": self.seq + 1, "stream": None, "batch": None, "path": None, "rows": 0, "level": 0, "replaces": []} | line
        self.spark.createDataFrame([tuple(line[c.split()[0]] for c in LOG.split(", "))], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self._take(line)

    def merged(self, paths: list[str]) -> DataFrame:
        """The newest row of each file in some parts.

        The texts of the largest part are not shuffled where Spark can send the other parts' keys to it: its rows stay unless
        another part has a newer one.
        """
        read = lambda *p: self.spark.read.schema(CHANGE).parquet(*p)
        if not paths:
            return self.spark.createDataFrame([], CHANGE)
        largest = max(paths, key=lambda p: self.parts[p][1])
        rest = [p for p in paths if p != largest]
        base = read(largest)
        if not rest:
            return base
        newer = latest(read(*rest))
        key = lambda df, name: df.select(F.lower("absolute_path").alias(f"{name}_path"), F.struct("version", "ts").alias(f"{name}_order"))
        same = F.col("key_path") == F.lower("absolute_path")
        own = F.struct("version", "ts")
        return newer.join(key(base, "key"), same & (F.col("key_order") > own), "left_anti").unionByName(base.join(key(newer, "key"), same & (F.col("key_order") >= own), "left_anti"))

    def apply(self, batch: DataFrame, number: int, stream: str = "") -> None:
        if number <= self.done.get(stream, -1):
            return  # a batch that is tried again
        new = stored(latest(batch.select(COLUMNS)), "live-changes").select(COLUMNS)
        held = self.merged(list(self.parts))
        stale = held.select(F.lower("absolute_path").alias("key_path"), F.struct("version", "ts").alias("key_order"))
        path = f"{self.folder}/parts/{uuid.uuid4().hex}"
        new.join(stale, (F.col("key_path") == F.lower("absolute_path")) & (F.col("key_order") > F.struct("version", "ts")), "left_anti").write.parquet(path)
        effective = self.spark.read.schema(CHANGE).parquet(path)
        rows = effective.count()
        if self.rebuild:
            self.parts[path] = (0, rows)
            try:
                self.rebuild(effective, self.current)  # raises before anything is committed
            finally:
                del self.parts[path]
        if not rows:
            remove(self.spark, path)
        self._commit(stream=stream, batch=number, path=path if rows else None, rows=rows)
        self.compact()

    def compact(self) -> None:
        """Merges levels with FAN_IN parts; files that were deleted leave with the last part that could hold them."""
        level = 0
        while (alike := [p for p, (k, _) in self.parts.items() if k == level]) or any(k > level for k, _ in self.parts.values()):
            if len(alike) >= FAN_IN:
                path, whole = f"{self.folder}/parts/{uuid.uuid4().hex}", len(alike) == len(self.parts)
                merged = self.merged(alike)
                (merged.where("op <> 'delete'") if whole else merged).write.parquet(path)
                self._commit(path=path, rows=self.spark.read.schema(CHANGE).parquet(path).count(), level=level + 1, replaces=alike)
            level += 1

    def vacuum(self) -> None:
        """Deletes parts that merges have replaced; no reader may still use them."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.folder}/log").select(F.explode("replaces").alias("path")).distinct().collect()
        remove(self.spark, *(r.path for r in rows if r.path not in self.parts))

    @property
    def current(self) -> DataFrame:
        return self.merged(list(self.parts)).where("op <> 'delete'")

    def start(self, stream: DataFrame, checkpoint: str):
        named, query = threading.Event(), []

        def each(batch: DataFrame, number: int) -> None:
            named.wait()  # the query's id is known once it has started
            self.apply(batch, number, query[0].id)

        query.append(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        named.set()
        return query[0]
