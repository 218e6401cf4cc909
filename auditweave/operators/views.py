"""What a reader is shown: labelled paths, queues, groups, pick lists and summary metrics, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave import catalog
from auditweave.functions import columns as C


def with_finding(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """paths with the finding that lists them; of several the one that comes last in their order."""
    listed = findings.select(F.explode("path_ids").alias("path_id"), F.struct(C.severity_rank("severity").alias("a"), C.confidence_rank("confidence").alias("b"), (-F.col("sort_score")).alias("c"), "at", "finding_id").alias("o"), F.struct("finding_id", "title", "severity").alias("finding"))
    return paths.join(listed.groupBy("path_id").agg(F.max_by("finding", "o").alias("finding")), "path_id", "left")


def labelled_paths(paths: DataFrame) -> DataFrame:
    """path_id with its summary, controls, confidence and size in words; with `finding` (with_finding) also its title."""
    names = F.array_distinct(F.transform("steps", lambda s: s.function_name))
    summary = F.concat(F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("()"))), " → "), F.lit(" · "), "category")
    part = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}")))
    controls = F.coalesce(F.nullif(F.concat_ws(" · ", part("validation"), part("authorization")), F.lit("")), F.lit("No control seen"))
    many = lambda n, noun: F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
    plain = F.concat(F.col("steps")[0].label, F.lit(" → "), F.element_at("steps", -1).label)
    title = F.coalesce(F.concat(F.upper("finding.severity"), F.lit(" · "), "finding.title"), plain) if "finding" in paths.columns else plain
    words = F.concat_ws(" · ", controls, C.label_of(catalog.CONFIDENCE_LABELS, "confidence", "Check match"), many(F.col("calls"), "call"), many(F.size("files"), "file"))
    return paths.select("path_id", title.alias("label"), words.alias("description"), summary.alias("detail"))


def labelled_steps(paths: DataFrame) -> DataFrame:
    """path_id, n, label, description, detail of every step."""
    s = paths.select("path_id", F.posexplode("steps").alias("n", "s"))
    matched = F.when((F.col("s.kind") == "call") & F.col("s.candidate_reason").isNotNull(), F.concat("s.code", F.lit(" · matched by "), "s.candidate_reason")).otherwise(F.col("s.code"))
    return s.select("path_id", (F.col("n") + 1).alias("n"), F.col("s.label").alias("label"), F.concat_ws(":", "s.relative_path", F.col("s.line").cast("string")).alias("description"), matched.alias("detail"))


def target_list(targets: DataFrame, absolute_path: str | None = None) -> DataFrame:
    """Targets (with status) as a pick list, of one file or all."""
    rows = targets.where(C.slashed("absolute_path") == absolute_path.replace("\\", "/").lower()) if absolute_path else targets
    return rows.select("target_id", F.concat_ws(" · ", "priority", "title").alias("label"), F.concat(C.label_of(catalog.STATUS_LABELS, "status", "Not reviewed"), F.lit(" · line "), F.col("line").cast("string")).alias("description"), F.array_join("reasons", " · ").alias("detail"))


def clue_list(signals: DataFrame) -> DataFrame:
    return signals.orderBy("line", "ordinal").select("line", F.format_string("Line %d · %s", "line", "label").alias("label"), F.col("kind").alias("description"), F.col("code").alias("detail"))


def queue(targets: DataFrame, hide_reviewed: bool = False) -> DataFrame:
    return targets.where((F.col("status") != "reviewed") | ~F.lit(hide_reviewed))


def grouped(rows: DataFrame, column: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Counts by one column in a fixed order, empty groups left out."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    if not order:
        return counts.orderBy(column)
    place = C.constant_map({v: i for i, v in enumerate(order)}, F.col(column), len(order))
    return counts.where(F.col(column).isin(*order)).orderBy(place)


def metrics(coverage: DataFrame, entries: int, findings: int, files: int, functions: int, languages: list[str], notes: int, partial: str | None = None) -> DataFrame:
    """The summary's rows: label, description; with a row in front if the index is partial."""
    head = [F.struct(F.lit("Index coverage").alias("label"), F.lit(partial).alias("description"))] if partial else []
    row = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("description"))
    rows = [
        row("Review coverage", F.format_string("%d%%", "coverage")), row("Attack surface", F.lit(f"{entries} entry points")), row("Potential findings", F.lit(f"{findings} paths")),
        row("Review queue", F.format_string("%d targets", "items")), row("Code indexed", F.lit(f"{files} files · {functions} functions")), row("Languages", F.lit(", ".join(languages) or "none")), row("Audit notes", F.lit(f"{notes} records")),
    ]
    return coverage.select(F.inline(F.array(*head, *rows)))


def evidence_of_target(target: DataFrame, kind: str, note: str, created_at: str) -> DataFrame:
    """An evidence row from a target: its first three signals as `line: code`, or its title."""
    lines = F.array_join(F.transform(F.slice("signals", 1, 3), lambda s: F.concat(s.line.cast("string"), F.lit(": "), s.code)), "\n")
    code = F.when(F.size("signals") > 0, lines).otherwise(F.col("title"))
    return target.select(C.short_hash(F.concat_ws(":", F.lit(created_at), "absolute_path", F.col("line").cast("string"), F.lit(kind), code)).alias("id"), F.lit(kind).alias("type"), F.lit(note).alias("note"), code.alias("code"), "relative_path", "absolute_path", "line", "end_line", F.lit(created_at).alias("created_at"))


def evidence_of_selection(files: DataFrame, absolute_path: str, line: int, end_line: int, kind: str, note: str, created_at: str) -> DataFrame:
    """An evidence row from selected lines of a file, the code trimmed."""
    if kind not in catalog.EVIDENCE_TYPES:
        raise ValueError(f"unknown evidence type {kind}")
    one = files.where(C.slashed("absolute_path") == absolute_path.replace("\\", "/").lower())
    code = F.trim(F.array_join(F.slice(F.split("text", "\r?\n"), line, end_line - line + 1), "\n"))
    place = {"line": F.lit(line), "end_line": F.lit(end_line)}
    return one.select(C.short_hash(F.concat_ws(":", F.lit(created_at), "absolute_path", F.lit(str(line)), F.lit(kind), code)).alias("id"), F.lit(kind).alias("type"), F.lit(note).alias("note"), code.alias("code"), "relative_path", "absolute_path", *(v.alias(k) for k, v in place.items()), F.lit(created_at).alias("created_at"))


def of_file(rows: DataFrame, absolute_path: str) -> DataFrame:
    """The rows of one file, of any table with file_id: lines, signals, functions, entries."""
    return rows.where(F.col("file_id") == C.short_hash(C.slashed(F.lit(absolute_path))))


def signals_at(signals: DataFrame, absolute_path: str, line: int) -> DataFrame:
    return of_file(signals, absolute_path).where(F.col("line") == line)


def needs_rebuild(changed_settings: list[str]) -> bool:
    """Whether changed settings invalidate paths and findings."""
    return any(s.rsplit(".", 1)[-1] in catalog.MODEL_SETTINGS for s in changed_settings)
