"""What must not grow with the input: broadcasts of tables, work per pair, rows through the driver."""

import pytest
from pyspark.sql import functions as F

from auditweave import queries
from auditweave.operators import structure
from auditweave.plans.audit import Audit

SCHEMA = "absolute_path string, relative_path string, language string, text string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_targets_broadcast_no_table_of_the_corpus(spark):
    files = spark.createDataFrame([(f"/ws/{n}.js", f"{n}.js", "javascript", 'router.post("/x", handler);\nconst v = req.query.v;\nfunction f(a) {\n  exec(a);\n}') for n in range(20)], SCHEMA)
    assert "BroadcastHashJoin" not in plan_of(Audit(files).targets)


def test_band_reaches_35_lines_both_ways(spark):
    read = "const v = req.query.v;"
    lines = [""] * 200
    lines[100] = 'router.post("/x", handler);'
    for at in (64, 65, 135, 136):  # two within 35 lines, two just outside
        lines[at] = read
    files = spark.createDataFrame([("/ws/a.js", "a.js", "javascript", "\n".join(lines))], SCHEMA)
    assert [(r.line, r.sources) for r in Audit(files).targets.collect()] == [(101, 2)]


def test_lines_work_out_only_what_is_asked_for(spark):
    files = spark.createDataFrame([("/ws/a.js", "a.js", "javascript", "function f(a) {\n  exec(a);\n}\n"), ("/ws/b.py", "b.py", "python", None)], SCHEMA)
    some = structure.lines(files, columns=["relative_path", "line", "owners", "facts"])
    assert some.columns == ["relative_path", "line", "owners", "facts"]
    every = structure.with_ids(files).select("file_id", "relative_path").join(structure.lines(files), "file_id")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(some.columns).collect()))


def test_equal_lines_are_read_once():
    pa = pytest.importorskip("pyarrow")
    seen = []
    got = structure.repeated(["a", "b", "a", "a"], lambda x: seen.append(x) or {"target": x}, pa.struct([("target", pa.string())]))
    assert seen == ["a", "b"] and [x["target"] for x in got.to_pylist()] == ["a", "b", "a", "a"]


def test_facts_and_names_read_later_are_the_same(spark):
    code = "function f(a) {\n  const b = g(a.x, 1); // c\n\n  exec(b);\n  return b;\n}"
    files = spark.createDataFrame([("/ws/a.js", "a.js", "javascript", code)], SCHEMA)
    whole, lean = structure.lines(files), structure.lines(files, columns=structure.PLACES)
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(whole.where(F.trim("masked") != ""), "line", "facts") == rows(structure.with_facts(lean), "line", "facts")
    assert rows(structure.signals(whole), "line", "given", "named") == rows(structure.with_names(structure.signals(lean)), "line", "given", "named")


def test_candidates_meet_few_suppliers(spark, tmp_path):
    """All suppliers of one nation, alike or not: a part meets no more than its kinds' first six."""
    spark.range(1, 4).selectExpr("id * 25 as p_partkey", "case when id < 3 then cast(id as int) end as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 2001).selectExpr("id as s_suppkey", "0 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    df = queries.q_call_candidates_topk(spark, str(tmp_path))
    got = {(r.p_partkey, r.place): (r.s_suppkey, r.score, r.quality) for r in df.collect()}
    want = {}
    for p, size in ((25, 1), (50, 2), (75, None)):
        scored = [(16 * (s % 7 == size) + 6 * (s % 3 == p % 3) + 2, s) for s in range(1, 2001)]
        strong = [x for x in scored if x[0] >= 16]
        best = sorted(strong or [x for x in scored if x[0] == max(scored)[0]], key=lambda x: (-x[0], x[1]))[:6]
        want |= {(p, n): (s, score, "high" if strong else "review") for n, (score, s) in enumerate(best, 1)}
    assert got == want
    joined = plan_of(df)
    assert "WindowGroupLimit" in joined  # suppliers are cut before they meet a question


def test_sessions_stay_with_the_tasks(spark):
    from auditweave.sources import sessions

    rows = spark.range(30).selectExpr("id % 3 as session", "concat('u', id) as item_id", "'reviewed' as status", "timestamp'2026-02-03' as updated_at", "cast(null as timestamp) as orphaned_at")
    notes = spark.createDataFrame([(7, "n", "note", "t", "c", "a.js", "/ws/a.js", 1, 1, "2026", "u1")], "session long, id string, type string, note string, code string, relative_path string, absolute_path string, line int, end_line int, created_at string, audit_item_id string")
    texts = sessions.export_many(rows, notes, "2026-02-04", "session")
    assert sorted(r.session for r in texts.select("session").collect()) == [0, 1, 2, 7]  # a session of notes alone, too
    statuses, found = sessions.parse_many(texts.select(F.col("json").alias("text")), {"ws": "/ws"})
    assert statuses.count() == 30 and found.count() == 1
    bad = texts.select(F.col("json").alias("text")).union(spark.createDataFrame([("{}",)], "text string"))
    with pytest.raises(ValueError, match="unsupported"):
        sessions.parse_many(bad, {"ws": "/ws"})


def test_findings_of_more_files_than_the_trace_explores(spark, tmp_path):
    """The interactive trace explores 10,000 paths at most; the audit's queries report every one."""
    spark.range(10_050).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "case when id % 2 = 0 then '1-URGENT' else '5-LOW' end as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.severity, r.findings) for r in queries.q_findings_by_severity(spark, str(tmp_path)).collect()} == {("critical", 5_025), ("medium", 5_025)}
    assert queries.q_findings(spark, str(tmp_path)).count() == queries.q_flow_paths(spark, str(tmp_path)).count() == 10_050
    assert queries.q_report_lines(spark, str(tmp_path)).where("line like '%impact /%'").count() == 10_050


def test_rows_of_batches_are_those_of_arrow():
    pa = pytest.importorskip("pyarrow")
    from auditweave.functions.arrow import rows_of

    kind = pa.struct([("s", pa.string()), ("l", pa.list_(pa.struct([("n", pa.int32()), ("t", pa.list_(pa.string()))]))), ("b", pa.bool_())])
    values = [None, {"s": "ä", "l": [], "b": True}, {"s": None, "l": [{"n": 1, "t": None}, None, {"n": None, "t": ["x", None]}], "b": None}, {"s": "", "l": None, "b": False}]
    batch = pa.RecordBatch.from_arrays([pa.array(values, kind), pa.array([1, None, 3, 4], pa.int64()), pa.nulls(4, pa.string()), pa.array([[1], [], None, [2, 3]], pa.list_(pa.int32()))], names=["a", "b", "c", "d"])
    for part in (batch, batch.slice(1), batch.slice(2, 1), batch.slice(1, 0)):
        assert rows_of(part) == part.to_pylist()


def test_operations_read_lines_and_signals_once_in_python(spark):
    files = spark.createDataFrame([("/ws/a.js", "a.js", "javascript", "function f(a) {\n  exec(a);\n}\nconst v = req.query.v;")], SCHEMA)
    a = Audit(files)
    assert plan_of(structure.operations(a.scopes, a.lines, a.functions, a.signals)).count("MapInArrow") == 2


def test_calls_of_names_that_no_function_has_meet_none(spark):
    """Only names that are both called and defined go on to the candidates' joins."""
    text = "function f(a) {\n  exec(a);\n  send(a);\n  G(a);\n}\nfunction g(b) {\n  exec(b);\n}"
    a, kept = Audit(spark.createDataFrame([("/ws/a.js", "a.js", "javascript", text)], SCHEMA)), {}
    from auditweave.operators import calls

    def keep(df, name):
        kept[name] = a.keep(df, name)
        return kept[name]

    found = calls.candidates(a.operations, a.scopes, keep)
    assert [r.callee_name for r in found.collect()] == ["g"]
    assert [r.called for r in kept["made-calls"].select("called").distinct().collect()] == ["g"] and kept["called-functions"].count() == 1


def test_all_paths_walk_every_root_at_once(spark, tmp_path, monkeypatch):
    """Paths that no limit cuts need no numbers, no slices of roots and no order."""
    from auditweave.operators import flow

    monkeypatch.setattr(flow, "numbered_roots", None)
    spark.range(1, 4).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert queries.q_cross_file_flow(spark, str(tmp_path)).count() == 6


def test_report_sorts_targets_not_lines(spark):
    """A target's lines come from one sorted row."""
    files = spark.createDataFrame([("/ws/a.js", "a.js", "javascript", "function f(a) {\n  exec(a);\n}\n")], SCHEMA)
    lines = Audit(files).report(spark.createDataFrame([], "item_id string, status string"), spark.createDataFrame([], "id string, type string, note string, code string, relative_path string, line int, created_at string"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode(lines") < plan.index("Sort [part")


def test_signals_send_no_null_lists_to_python(spark, monkeypatch):
    """Spark sizes an Arrow batch after every row, which counts a column of null lists from its start."""
    files = spark.createDataFrame([("/ws/a.js", "a.js", "javascript", "function f(a) {\n  exec(a);\n}\nconst v = req.query.v;")], SCHEMA)
    found, sent, read = structure.signals(structure.lines(files, columns=structure.PLACES)), [], structure.read_again
    monkeypatch.setattr(structure, "read_again", lambda rows, *more, **kernels: sent.append(rows) or read(rows, *more, **kernels))
    named = structure.with_names(found)
    assert sent[0].where("variables is null").isEmpty() and named.where("variables is null").count() == found.count() == 2
    assert named.columns == [*found.columns, "given", "named"]
