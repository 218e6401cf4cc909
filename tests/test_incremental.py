"""An incremental audit equals a full one after every change, and rewrites no table of what a change leaves alone."""

from pyspark.sql import functions as F

from auditweave.plans.audit import Audit
from auditweave.plans.incremental import IncrementalAudit
from auditweave.streaming import live

CHANGE = "absolute_path string, relative_path string, language string, text string, op string"


def change(path, text, op="save"):
    return ("/ws/" + path, path, "javascript", text, op)


ROUTE = 'import { run } from "./service";\nfunction entry(req, res) {\n  const v = req.query.v;\n  run(v);\n  const w = back(v);\n  res.send(w);\n}\n'
SERVICE = "function run(value) {\n  exec(value);\n}\n"
BACK = "function back(x) {\n  return hand(x);\n}\n"
HAND = "function hand(y) {\n  const z = y;\n  return z;\n}\n"
ALONE = "function quiet(req) {\n  const q = req.query.q;\n  fetch(q);\n}\n"


def said(paths):
    return sorted((r.category, r.confidence, r.review_priority, tuple(r.files), tuple((s.kind, s.label, s.relative_path, s.line) for s in r.steps)) for r in paths.collect())


def test_every_change_leads_to_the_full_audit(spark, tmp_path):
    """The live index hands each batch's changes to the audit."""
    inc = IncrementalAudit(spark, f"file://{tmp_path}/audit", max_paths=50)
    index = live.LiveIndex(spark, f"file://{tmp_path}/index", lambda changed, current: inc.apply(changed))
    texts = {}
    steps = [
        [change("route.js", ROUTE), change("service.js", SERVICE), change("back.js", BACK), change("hand.js", HAND), change("alone.js", ALONE)],
        [change("service.js", SERVICE.replace("exec(value)", "validate(value);\n  db.query(value)"))],  # what is called changes
        # what gives back two calls away goes and comes from elsewhere, and another file answers to the import
        [change("hand.js", None, "delete"), change("more.js", "function hand(a) {\n  return a;\n}\n"), change("near/service.js", SERVICE.replace("run", "other")), change("route.js", ROUTE.replace("./service", "./near/service").replace("run", "other"))],
    ]
    for n, step in enumerate(steps):
        index.apply(spark.createDataFrame(step, CHANGE).withColumns({"version": F.lit(n).cast("long"), "ts": F.to_timestamp(F.lit("2026-01-01"))}), n, "s")
        for path, relative, language, text, op in step:
            texts[path] = (path, relative, language, text)
            if op == "delete":
                del texts[path]
        if n == 2:
            full = Audit(spark.createDataFrame(list(texts.values()), CHANGE.rsplit(",", 1)[0]), max_paths=50, exhaustive=True)
            assert said(inc.paths) == said(full.paths) and inc.table("lines").count() == full.lines.count()
    assert sorted(r.rule_id for r in inc.findings.collect()) == sorted(r.rule_id for r in full.findings.collect()) and inc.table("resolved").count() == full.resolved.count()
    # what the second change wrote: the service's own tables, the calls of its name, and the functions that reach them
    names = {r.scope_id: r.name for n in (0, 1) for r in spark.read.parquet(f"{tmp_path}/audit/scopes/{n}").collect()}
    assert {r.relative_path for r in spark.read.parquet(f"{tmp_path}/audit/scopes/1").collect()} == {"service.js"}
    assert {names[r.scope_id] for r in spark.read.parquet(f"{tmp_path}/audit/changed_resolved/1").collect()} == {"run", "entry"}
    assert {names[r.scope_id] for r in spark.read.parquet(f"{tmp_path}/audit/changed_paths/1").collect()} == {"run", "entry"}
    again = IncrementalAudit(spark, f"file://{tmp_path}/audit", max_paths=50)
    assert again.parts == inc.parts == [0, 1, 2] and again.table("scopes").count() == full.scopes.count()
