"""Review state as keyed tables: statuses, evidence, reconciliation, imports, changes and invalidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from auditweave import catalog


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """current with the rows of changes in place of those with equal keys."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def delete(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keys.select(*key), key, "left_anti")


def changed_keys(before: DataFrame, after: DataFrame, key: str, print_: Column | None = None) -> DataFrame:
    """Keys whose fingerprint differs, or that only one side has."""
    b = before.select(F.col(key), F.lit(True).alias("_b"), (print_ if print_ is not None else F.col("fingerprint")).alias("_bp"))
    a = after.select(F.col(key), F.lit(True).alias("_a"), (print_ if print_ is not None else F.col("fingerprint")).alias("_ap"))
    both = b.join(a, key, "full_outer")
    return both.where("_a is null or _b is null or not (_ap <=> _bp)").select(key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed").alias("change"))


def set_status(statuses: DataFrame, item_id: str, status: str, now: str, legacy_ids: list[str] = ()) -> DataFrame:
    """statuses (item_id, status, updated_at, orphaned_at) with one set; unreviewed removes it; legacy ids always go."""
    if status not in catalog.STATUSES:
        raise ValueError(f"unknown status {status}")
    left = statuses.where(~F.col("item_id").isin([item_id, *legacy_ids]))
    if status == "unreviewed":
        return left
    row = statuses.sparkSession.range(1).select(F.lit(item_id).alias("item_id"), F.lit(status).alias("status"), F.to_timestamp(F.lit(now)).alias("updated_at"), F.lit(None).cast("timestamp").alias("orphaned_at"))
    return left.unionByName(row.select(left.columns))


def focus(items: DataFrame, statuses: DataFrame, item_id: str, now: str) -> DataFrame:
    """statuses after an item (item_id, legacy_ids) was opened: what was unreviewed is in review now."""
    row = with_status(items.where(F.col("item_id") == item_id), statuses).first()
    return set_status(statuses, item_id, "in_review", now, row.legacy_ids) if row and row.status == "unreviewed" else statuses


def set_status_at(targets: DataFrame, statuses: DataFrame, absolute_path: str, line: int, status: str, now: str) -> DataFrame:
    """statuses after the innermost target at a place got one; as they were if none is there."""
    row = innermost(targets, absolute_path, line).first()
    return set_status(statuses, row.target_id, status, now, [row.legacy_id]) if row else statuses


def focus_at(targets: DataFrame, statuses: DataFrame, absolute_path: str, line: int, now: str, reindex: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, Row | None]:
    """(statuses, target) after the innermost target at a place was opened for review: what was unreviewed is in review now.

    If none is there, reindex() reads the file again, as it may have changed, and gives the targets to look among once more.
    """
    row = innermost(targets, absolute_path, line).first()
    if row is None and reindex is not None:
        targets = reindex()
        row = innermost(targets, absolute_path, line).first()
    if row is None:
        return statuses, None
    items = targets.select(F.col("target_id").alias("item_id"), F.array("legacy_id").alias("legacy_ids"))
    return focus(items, statuses, row.target_id, now), row


def with_status(items: DataFrame, statuses: DataFrame) -> DataFrame:
    """items (item_id, legacy_ids) with their status, by id or the first legacy id that has one; else unreviewed."""
    known = statuses.select("item_id", F.col("status").alias("_own"))
    old = items.select("item_id", F.posexplode("legacy_ids").alias("n", "legacy")).join(known.select(F.col("item_id").alias("legacy"), F.col("_own").alias("_old")), "legacy")
    old = old.groupBy("item_id").agg(F.min_by("_old", "n").alias("_old"))
    return items.join(known, "item_id", "left").join(old, "item_id", "left").withColumn("status", F.coalesce("_own", "_old", F.lit("unreviewed"))).drop("_own", "_old")


def coverage(rated: DataFrame) -> DataFrame:
    """Counts by status and the reviewed share in per cent, rounded half up; 0 without items."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = rated.agg(F.count("*").alias("items"), n("reviewed").alias("reviewed"), n("in_review").alias("in_review"), n("blocked").alias("blocked"))
    return counts.select("*", (F.col("items") - F.col("reviewed") - F.col("in_review") - F.col("blocked")).alias("unreviewed"), F.when(F.col("items") == 0, 0).otherwise(F.floor(100.0 * F.col("reviewed") / F.col("items") + 0.5)).cast("bigint").alias("coverage"))


def reconcile(statuses: DataFrame, items: DataFrame, now: Column, complete: bool, retention_days: int = catalog.RETENTION_DAYS) -> DataFrame:
    """statuses after an index of items (item_id, legacy_ids), with what happened to each: kept, migrated, orphaned, removed.

    Legacy ids hand their status to the stable id that has none and disappear; active items are no orphans; after a complete
    index missing ones become orphans, and leave after the retention. Rows with action `removed` are to be dropped.
    """
    legacy = items.select("item_id", F.posexplode("legacy_ids").alias("n", "legacy")).withColumnRenamed("item_id", "stable")
    known = statuses.select(F.col("item_id").alias("legacy"), F.struct("status", "updated_at").alias("record"))
    given = legacy.join(known, "legacy").groupBy("stable").agg(F.min_by("record", "n").alias("record"))
    own = statuses.join(legacy.select(F.col("legacy").alias("item_id")).distinct(), "item_id", "left_anti")
    moved = given.join(own.select(F.col("item_id").alias("stable")), "stable", "left_anti").select(F.col("stable").alias("item_id"), "record.status", "record.updated_at", F.lit(None).cast("timestamp").alias("orphaned_at"), F.lit("migrated").alias("action"))
    active = items.select("item_id", F.lit(True).alias("active"))
    rest = own.join(active, "item_id", "left")
    missing = F.col("active").isNull() & F.lit(complete)
    expired = missing & F.col("orphaned_at").isNotNull() & (now.cast("long") - F.col("orphaned_at").cast("long") >= retention_days * 86_400)
    orphaned = F.when(F.col("active"), F.lit(None).cast("timestamp")).when(missing & F.col("orphaned_at").isNull(), now).otherwise(F.col("orphaned_at"))
    action = F.when(expired, "removed").when(missing & F.col("orphaned_at").isNull(), "orphaned").otherwise("kept")
    return rest.select("item_id", "status", "updated_at", orphaned.cast("timestamp").alias("orphaned_at"), action.alias("action")).unionByName(moved)


def add_evidence(evidence: DataFrame, added: DataFrame, most: int = catalog.MAX_EVIDENCE) -> DataFrame:
    """The newest `most` notes (created_at), long fields cut."""
    cut = {"note": 10_000, "code": 50_000, "relative_path": 2_000, "id": 128}
    rows = evidence.unionByName(added.withColumns({c: F.substring(c, 1, n) for c, n in cut.items()}))
    return rows.orderBy(F.desc("created_at"), "id").limit(most)


def remove_evidence(evidence: DataFrame, note_id: str) -> DataFrame:
    return evidence.where(F.col("id") != note_id)


def merge_by_id(current: DataFrame, imported: DataFrame, key: str, most: int) -> DataFrame:
    """Imported rows replace those of equal key in their place; new ones follow; at most `most`. Both have ord."""
    both = current.withColumn("_new", F.lit(0)).unionByName(imported.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key)
    latest = w.orderBy(F.desc("_new"), F.desc("ord"))
    placed = both.withColumns({"_first": F.min(F.struct("_new", "ord")).over(w), "_k": F.row_number().over(latest)}).where("_k = 1")
    return placed.orderBy("_first").limit(most).drop("_new", "_k", "_first")


def affected_files(changed: DataFrame, owns: DataFrame, depends: DataFrame, keep) -> DataFrame:
    """Files to analyse again: the changed ones (file, function_id) and all that depend on them, over any number of steps.

    owns: (file, function_id) each file's functions; depends: (file, function_id) what each file calls. A frontier loop:
    each round joins only the files added by the last.
    """
    reached = changed.select("file").distinct()
    front = changed.select("function_id").distinct()
    while True:
        new = keep(depends.join(front, "function_id").select("file").distinct().join(reached, "file", "left_anti"), "affected")
        if new.isEmpty():
            return reached
        reached = reached.union(new)
        front = owns.join(new, "file").select("function_id").distinct()


def update_cache(records: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache records after files were analysed, and which functions changed.

    Both hold file, version, functions (array<struct<id, fingerprint>>) and dependencies (function ids). A file whose version
    is known already is a hit: its record stays and nothing changed. changes: file, function_id; affected_files() goes on
    from there.
    """
    known = records.select("file", "version").withColumn("hit", F.lit(True))
    new = incoming.join(known, ["file", "version"], "left_anti")
    each = lambda df: df.select("file", F.explode("functions").alias("f")).select("file", "f.id", "f.fingerprint")
    before = each(records.join(new.select("file"), "file", "left_semi")).withColumnRenamed("fingerprint", "_before").withColumn("_old", F.lit(True))
    both = each(new).withColumn("_new", F.lit(True)).join(before, ["file", "id"], "full_outer")
    changed = both.where("_new is null or _old is null or not (fingerprint <=> _before)").select("file", F.col("id").alias("function_id"))
    return upsert(records, new, ["file"]), changed


def remove_cached(records: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Cache records without a file, and its functions as changes."""
    gone = records.where(F.col("file") == file)
    return records.where(F.col("file") != file), gone.select("file", F.explode("functions").alias("f")).select("file", F.col("f.id").alias("function_id"))


def cache_tables(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owns and depends of affected_files()."""
    return records.select("file", F.explode("functions").alias("f")).select("file", F.col("f.id").alias("function_id")), records.select("file", F.explode("dependencies").alias("function_id"))


def cache_snapshot(records: DataFrame) -> DataFrame:
    return records.select(F.col("file").alias("key"), "version", F.size("functions").alias("functions"), F.size(F.array_distinct("dependencies")).alias("dependencies"))


def innermost(rows: DataFrame, absolute_path: str, line: int) -> DataFrame:
    """The smallest item (line, end_line) that holds a place."""
    found = rows.where((F.lower("absolute_path") == absolute_path.lower()) & (F.col("line") <= line) & (F.col("end_line") >= line))
    return found.orderBy(F.col("end_line") - F.col("line"), "line").limit(1)


def sessions_last(events: DataFrame, key: str, ts: str, value: str, tie: str, gap: str = f"{catalog.DEBOUNCE_MS} milliseconds") -> DataFrame:
    """Debounce: of every burst of edits (gaps under `gap`) the last value; equal times go to the larger tie."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias("last"), F.count("*").alias("edits")).drop("w")
