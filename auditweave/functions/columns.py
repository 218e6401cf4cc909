"""Scalar functions of the audit model as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditweave import catalog

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def constant_map(values: dict, key: Column, default) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.element_at(table, key), F.lit(default))


def short_hash(text: Name) -> Column:
    return F.substring(F.sha1(col(text).cast("binary")), 1, 16)


def slashed(path: Name) -> Column:
    return F.lower(F.replace(col(path), F.lit("\\"), F.lit("/")))


def directory(path: Name) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def canonical_name(name: Name) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(col(name), F.lit("")), "[^A-Za-z0-9]", ""))


def language_of(path: Name, extensions: dict[str, tuple[str, ...]] = catalog.EXTENSIONS) -> Column:
    extension = F.lower(F.regexp_extract(col(path), r"(\.[^./\\]*)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for lang, exts in extensions.items() for e in exts for x in (e, lang))), extension)


def reference_path(target: Name) -> Column:
    """An import target as a path without extension and leading dots."""
    p = F.regexp_replace(F.replace(col(target), F.lit("\\"), F.lit("/")), r"(?i)\.(?:js|jsx|mjs|cjs|ts|tsx|py|php|java|cs|go)$", "")
    p = F.when(F.contains(p, F.lit("/")), p).otherwise(F.replace(p, F.lit("."), F.lit("/")))
    return F.regexp_replace(F.regexp_replace(F.lower(p), r"^(?:\.\./|\./)+", ""), "^/+", "")


def reference_name(target: Name) -> Column:
    p = F.regexp_replace(F.replace(col(target), F.lit("\\"), F.lit("/")), r"(?i)\.(?:js|jsx|mjs|cjs|ts|tsx|py|php|java|cs|go)$", "")
    return F.coalesce(F.try_element_at(F.filter(F.split(p, "[/.]"), lambda x: x != ""), F.lit(-1)), F.lit(""))


def file_names(path: Name) -> Column:
    """The canonical names a file answers to: its stem, and for an index file its directory."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(p, "/"), -1)
    stem = F.when(F.rlike(base, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    parent = F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(-2)), F.lit("."))
    names = F.when(F.lower(stem) == "index", F.array(canonical_name(stem), canonical_name(parent))).otherwise(F.array(canonical_name(stem)))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def reference_match(target: Name, path: Name) -> Column:
    """exact, name or none: whether an import target means a file."""
    wanted, have = reference_path(target), F.regexp_replace(slashed(path), r"\.[a-z0-9]+$", "")
    exact = (wanted != "") & ((have == wanted) | F.endswith(have, F.concat(F.lit("/"), wanted)) | F.endswith(have, F.concat(F.lit("/"), wanted, F.lit("/index"))))
    name = canonical_name(reference_name(target))
    return F.when(col(target).isNull(), "none").when(exact, "exact").when((name != "") & F.array_contains(file_names(path), name), "name").otherwise("none")


def said(label: Name, code: Name) -> Column:
    return F.concat(F.coalesce(col(label), F.lit("")), F.lit(" "), F.coalesce(col(code), F.lit("")))


def source_kind(label: Name, code: Name) -> Column:
    out = F.lit("EXTERNAL_INPUT")
    for kind, words in reversed(catalog.SOURCE_WORDS):
        out = F.when(F.rlike(said(label, code), F.lit(words)), kind).otherwise(out)
    return out


def sink_kind(category: Name) -> Column:
    return constant_map(catalog.SINK_KINDS, F.coalesce(col(category), F.lit("")), "SENSITIVE_OPERATION")


def sink_rank(category: Name) -> Column:
    return constant_map(catalog.SINK_RANKS, F.coalesce(col(category), F.lit("")), 1)


def guard_capabilities(kind: Name, label: Name, code: Name) -> Column:
    text = said(label, code)
    auth = F.when(col(kind) == "auth", F.when(F.rlike(text, F.lit(catalog.AUTHENTICATION_WORDS)), "AUTHENTICATION").otherwise("AUTHORIZATION"))
    found = F.array_compact(F.array(auth, *(F.when(F.rlike(text, F.lit(words)), F.lit(name)) for name, words in catalog.GUARDS)))
    return F.when((col(kind) == "sanitizer") & (F.size(found) == 0), F.array(F.lit("INPUT_VALIDATION"))).otherwise(found)


def severity_rank(severity: Name) -> Column:
    return constant_map({s: i for i, s in enumerate(catalog.SEVERITIES)}, col(severity), 4)


def risk_confidence(confidence: Name) -> Column:
    return F.when(col(confidence).isin("high", "medium"), col(confidence)).otherwise("low")


def confidence_rank(confidence: Name) -> Column:
    return constant_map({"high": 0, "medium": 1, "low": 2}, col(confidence), 2)


def sort_score(severity: Name, confidence: Name, source: Name, missing: Name) -> Column:
    external = F.when(col(source) != "SELECTED_SYMBOL", 5).otherwise(0)
    return (5 - severity_rank(severity)) * 100 + (3 - confidence_rank(risk_confidence(confidence))) * 10 + external + F.least(F.lit(4), col(missing))


def priority(score: Name) -> Column:
    return F.when(col(score) >= 50, "P0").when(col(score) >= 32, "P1").otherwise("P2")


def fence(text: Name) -> Column:
    """Backticks enough to fence a text in Markdown."""
    longest = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def squeezed(text: Name) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def first_line(text: Name) -> Column:
    return F.substring(F.split(F.coalesce(col(text), F.lit("")), r"\r?\n")[0], 1, 280)


def trace_role(code: Name, identifier: Name, kinds: Name) -> Column:
    """The role of a mention: by the line's signal kinds, else by its form. identifier: a column of plain identifiers."""
    # The forms of assignments, conditions and parameters.
    quoted = F.concat(F.lit(r"(?<![\w$])\Q"), col(identifier), F.lit(r"\E(?![\w$])"))
    assigned, condition, parameter = F.concat(quoted, F.lit(r"\s*(?::[^=]+)?=")), F.lit(r"\b(?:if|else if|while|switch|case|match)\b"), F.concat(F.lit(r"(?:function|def|func|public|private|protected|internal).*\([^)]*"), quoted)
    has = lambda k: F.array_contains(col(kinds), k)
    return (
        F.when(has("source"), "input").when(has("sink"), "sensitive-use").when(has("sanitizer"), "validation").when(has("auth"), "security-decision")
        .when(F.rlike(col(code), assigned), "assignment").when(F.rlike(col(code), condition), "condition").when(F.rlike(col(code), parameter), "parameter").otherwise("reference")
    )


def label_of(values: dict, key: Name, default: str) -> Column:
    return constant_map(values, F.coalesce(col(key), F.lit("")), default)
