from pyspark.sql import functions as F

from auditweave.functions import columns as C
from auditweave.operators import state, views
from auditweave.plans.audit import Audit


def test_views(spark):
    text = "function run(req) {\n  const t = req.query.t;\n  exec(t);\n}\n"
    a = Audit(spark.createDataFrame([("/ws/m.js", "m.js", "javascript", text)], "absolute_path string, relative_path string, language string, text string"))
    joined = views.with_finding(a.paths, a.findings)
    row = views.labelled_paths(joined).first()
    assert row.label == "CRITICAL · Potential command injection" and row.description == "No control seen · High match · 0 calls · 1 file" and row.detail == "run() · command"
    assert [r.label for r in views.labelled_steps(a.paths).orderBy("n").collect()] == ["HTTP request data", "Operating-system command"]
    targets = a.targets.withColumn("status", F.lit("reviewed"))
    assert views.target_list(targets, "/ws/m.js").first().description == "Reviewed · line 1" and views.queue(targets, True).isEmpty() and views.queue(targets).count() == 1
    assert [(r.priority, r.n) for r in views.grouped(targets, "priority", ("P0", "P1", "P2")).collect()] == [("P1", 1)]
    assert views.evidence_of_target(targets, "Sink", "n", "2026-01-01").first().code == "2: const t = req.query.t;\n3: exec(t);"
    summary = views.metrics(state.coverage(targets.select("status")), 0, 1, 1, 1, ["javascript"], 0, "Current files only").collect()
    assert len(summary) == 8 and summary[1].description == "100%"
    assert views.clue_list(a.signals).count() == 2 and a.summaries.first().sinks == ["COMMAND_EXEC"]
    assert views.needs_rebuild(["x.flowMaxDepth"]) and not views.needs_rebuild(["x.enableCodeLens"])


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(C.fence(F.lit(t))) for t in ("plain", "a ``` b", "``````")] == ["```", "````", "```````"]
    assert [get(C.language_of(F.lit(p))) for p in ("A.JSP", "b.phtml", "c.MJS", "d.tsx", "e.py", "f.cs", "g.go", "h.md")] == ["java", "php", "javascript", "typescript", "python", "csharp", "go", None]
    assert get(C.reference_match(F.lit("./services/shell"), F.lit("lib/services/shell.js"))) == "exact"
    assert get(C.reference_match(F.lit("com.acme.Shell"), F.lit("x/Shell.java"))) == "name" and get(C.reference_match(F.lit("./a"), F.lit("b.js"))) == "none"
    assert get(C.file_names(F.lit("lib/tools/index.ts"))) == ["index", "tools"] and get(C.directory(F.lit("a.js"))) == "." and get(C.directory(F.lit("x\\y\\a.js"))) == "x/y"
    assert get(C.source_kind(F.lit("Process or console input"), F.lit("sys.argv"))) == "PROCESS_INPUT" and get(C.sink_kind(F.lit("odd"))) == "SENSITIVE_OPERATION"
    assert get(C.guard_capabilities(F.lit("auth"), F.lit("Authorization decision"), F.lit("can(x)"))) == ["AUTHORIZATION"]
    assert get(C.first_line(F.lit("a\r\nb"))) == "a" and get(C.squeezed(F.lit(" a \n b "))) == "a b"
    assert get(C.sort_score(F.lit("critical"), F.lit("review"), F.lit("SELECTED_SYMBOL"), F.lit(9))) == 514
