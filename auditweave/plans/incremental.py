"""An audit kept up to date: a change rewrites the tables of changed files and of what depends on them, nothing else.

Every table is a set of parts, one a change. Tables of files (lines to operations) hold the changed files' rows; tables of
functions (resolved calls, return facts, paths) hold the rows of the functions whose result can have changed:

* calls are resolved again in changed files, and wherever a name is called that a changed file defines or defined;
* facts and paths are made again for those functions and all that reach them by calls, before the change or after it.

A part's rows count as long as no later part names their file or function, so what a change leaves alone is not read to be
written. A change is committed by one line in a log, after all its parts lie there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.frontends import BUILT_IN, Frontends
from auditweave.functions import columns as C
from auditweave.operators import calls, findings, flow, structure
from auditweave.plans.audit import Audit
from auditweave.storage import stored

FILE_TABLES = ("files", "lines", "signals", "functions", "entries", "scopes", "operations")
FUNCTION_TABLES = ("resolved", "facts", "paths")


class IncrementalAudit:
    """The exhaustive audit of a corpus that changes. changes: absolute_path, relative_path, language, text, op (`delete` removes)."""

    def __init__(self, spark: SparkSession, folder: str, *, max_depth: int = 6, max_paths: int = 200, frontends: Frontends = BUILT_IN):
        self.spark, self.folder, self.max_depth, self.max_paths, self.frontends = spark, folder.rstrip("/"), max_depth, max_paths, frontends
        try:
            self.parts = [r.part for r in spark.read.schema("part int").parquet(f"{self.folder}/log").orderBy("part").collect()]  # one line a change
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.parts = []
        self.schemas: dict = {}

    def _write(self, df: DataFrame, table: str, part: int) -> DataFrame:
        path = f"{self.folder}/{table}/{part}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, table: str, parts: list[int]) -> DataFrame:
        """The rows that count: of each file's or function's parts the last one, unless it is gone."""
        key, names = ("file_id", "changed_files") if table in FILE_TABLES else ("scope_id", f"changed_{table}")
        if table not in self.schemas:
            self.schemas[table] = self.spark.read.parquet(f"{self.folder}/{table}/{parts[-1]}").schema
        rows = self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.folder}/{table}/{n}" for n in parts))
        if len(parts) == 1:
            return rows.drop("part")
        last = self.spark.read.schema(f"{key} string, part int").parquet(*(f"{self.folder}/{names}/{n}" for n in parts)).groupBy(key).agg(F.max("part").alias("part"))
        return rows.join(last, [key, "part"], "left_semi").drop("part")

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.parts)

    def apply(self, changes: DataFrame) -> None:
        spark, part, before = self.spark, (self.parts[-1] + 1 if self.parts else 0), self.parts
        after, keep = [*before, part], stored
        numbered = lambda df: df.withColumn("part", F.lit(part))
        ids = structure.with_ids(changes)
        changed = self._write(numbered(ids.select("file_id").distinct()), "changed_files", part)
        # tables of the changed files
        present = keep(changes.where("op <> 'delete' and text is not null and language is not null").select("absolute_path", "relative_path", "language", "text"), "changed-texts")
        own = Audit(present, frontends=self.frontends)
        new = {name: self._write(numbered(structure.with_ids(present) if name == "files" else getattr(own, name)), name, part) for name in FILE_TABLES if name != "operations"}
        operations = own.operations.join(own.scopes.select("scope_id", "file_id"), "scope_id")
        new["operations"] = self._write(numbered(operations), "operations", part)
        self.schemas |= {k: v.schema for k, v in new.items()}
        scopes, events = self._read("scopes", after), self._read("operations", after)
        gone = new["scopes"].select("scope_id", F.lower("name").alias("called"))
        if before:
            gone = gone.union(self._read("scopes", before).join(changed, "file_id", "left_semi").select("scope_id", F.lower("name")))
        touched = keep(gone.distinct(), "changed-functions")
        # calls that can mean something else now
        again = events.where("kind = 'call'").withColumn("called", F.lower("call.callee")).join(touched.select("called").distinct(), "called", "left_semi").select("scope_id")
        again = keep(again.union(touched.select("scope_id")).distinct(), "callers-again")
        self._write(numbered(again), "changed_resolved", part)
        found = calls.candidates(events.join(again, "scope_id", "left_semi"), scopes, keep)
        self.schemas["resolved"] = self._write(numbered(found), "resolved", part).schema
        resolved = self._read("resolved", after)
        # functions that reach them, by calls before or after the change
        edges = resolved.select("scope_id", "callee_id")
        if before:
            edges = edges.union(self._read("resolved", before).select("scope_id", "callee_id"))
        reach = self._closure(again, keep(edges.distinct(), "call-edges"), "callee_id", "scope_id", None)
        for table in ("facts", "paths"):
            self._write(numbered(reach), f"changed_{table}", part)
        of = lambda df, some: df.join(some, "scope_id", "left_semi")
        known = self._read("facts", before).join(reach, "scope_id", "left_anti") if before else None
        plain = keep(flow.flow_functions(of(scopes, reach), of(events, reach), of(resolved, reach), known), "reached-functions")
        facts, _ = flow.return_facts(plain, scopes, events, resolved, keep, known)
        self.schemas["facts"] = self._write(numbered(of(facts, reach)), "facts", part).schema
        # paths from the roots in those functions, over all functions they reach in turn
        walked = self._closure(reach, keep(resolved.select("scope_id", "callee_id").distinct(), "call-edges-now"), "scope_id", "callee_id", self.max_depth)
        fns = keep(flow.flow_functions(of(scopes, walked), of(events, walked), of(resolved, walked), facts), "walked-functions")
        started = flow.roots(of(scopes, reach), of(events, reach)).withColumns({"tainted": F.col("names"), "start_line": F.col("at"), "root": F.monotonically_increasing_id()})
        started = keep(started.select("root", "scope_id", "n", "tainted", "start_line", "step"), "roots-again")
        ended = flow.advanced(started, fns, keep, self.max_depth).join(started.select("root", "scope_id", "n", "tainted", "start_line"), "root").drop("root")
        self.schemas["paths"] = self._write(numbered(ended), "paths", part).schema
        spark.createDataFrame([(part,)], "part int").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self.parts = after

    def _closure(self, some: DataFrame, edges: DataFrame, from_: str, to: str, rounds: int | None) -> DataFrame:
        """scope_id: some and what is reached from there, a frontier a round."""
        reached = front = some
        while rounds is None or rounds > 0:
            front = stored(edges.join(front.withColumnRenamed("scope_id", from_), from_, "left_semi").select(F.col(to).alias("scope_id")).distinct().join(reached, "scope_id", "left_anti"), "reached")
            if front.isEmpty():
                break
            reached, rounds = reached.union(front), None if rounds is None else rounds - 1
        return stored(reached, "all-reached")

    @property
    def ranks(self) -> DataFrame:
        return calls.potential_ranks(self.table("scopes"), self.table("operations"), self.table("resolved"), stored, min(4, max(1, self.max_depth)))

    @property
    def paths(self) -> DataFrame:
        """The best max_paths paths of all there are."""
        roots = flow.numbered_roots(self.table("scopes"), self.table("operations"), self.ranks).drop("step")
        placed = self.table("paths").join(roots, ["scope_id", "n", "tainted", "start_line"]).select("root", "trail", "steps")
        return flow.first_alike(flow.describe(placed)).drop("dedupe").orderBy(*flow.path_order()).limit(self.max_paths)

    @property
    def findings(self) -> DataFrame:
        return findings.evaluate(self.paths, findings.rules(self.spark))

    @property
    def targets(self) -> DataFrame:
        from auditweave.operators import review

        return review.targets(self.table("files").drop("file_id"), *(self.table(t) for t in ("lines", "functions", "signals", "entries")))

    def focus_at(self, statuses: DataFrame, file: DataFrame, line: int, now: str) -> tuple[DataFrame, object]:
        """(statuses, target) after the function at a line of a file (one row, as read now) was opened; the file is indexed again if nothing is there."""
        from auditweave.operators.state import focus_at

        def reindex() -> DataFrame:
            self.apply(file)
            return self.targets

        return focus_at(self.targets, statuses, file.first().absolute_path, line, now, reindex)
