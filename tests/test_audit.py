import pytest

from auditweave.operators import flow
from auditweave.plans.audit import Audit


def build(spark, *rows, **more):
    schema = "absolute_path string, relative_path string, language string, text string"
    return Audit(spark.createDataFrame([("/ws/" + p, p, lang, text) for p, lang, text in rows], schema), **more)


@pytest.fixture(scope="module")
def sample(spark):
    return build(
        spark,
        ("routes/controller.js", "javascript", '\nimport { runTask } from "../services/service";\napp.post("/run", (req, res) => {\n  const command = req.body.command;\n  runTask(command);\n});\n'),
        ("services/service.js", "javascript", '\nimport { executeCommand } from "./shell";\nexport function runTask(value) {\n  validate(value);\n  executeCommand(value);\n}\n'),
        ("services/shell.js", "javascript", "\nexport function executeCommand(command) {\n  child_process.exec(command);\n}\n"),
        ("other/shell.js", "javascript", "\nexport function executeCommand(command) {\n  return 1;\n}\n"),
        ("Web/UserController.java", "java", '\nclass UserController {\n  @PreAuthorize("x")\n  @GetMapping("/users/{id}")\n  public String show(@PathVariable String id) {\n    PreparedStatement s = db.prepareStatement("select ?");\n    return s.executeQuery(id);\n  }\n}\n'),
        ("a.py", "python", '\nfrom flask import request\n@app.post("/fetch")\ndef fetch():\n    url = request.json["url"]\n    requests.get(url)\n'),
        ("x.php", "php", "<?php system($_GET['cmd']);\n"),
        ("calm.js", "javascript", "function add(a, b) {\n  // eval(a)\n  return a + 'exec(x)' + b;\n}\n"),
        ("same.js", "javascript", "function h(req, res) {\n  const a = req.query.a;\n  const b = identity(a);\n  res.send(b);\n}\n"),
        ("lib/identity.js", "javascript", "function identity(v) {\n  return v;\n}\n"),
        ("main.go", "go", 'package main\nfunc main() {\n  http.HandleFunc("/proxy", proxy)\n}\nfunc proxy(w http.ResponseWriter, r *http.Request) {\n  u := r.FormValue("u")\n  http.Get(u)\n}\n'),
        ("Run.cs", "csharp", '\n[Authorize]\n[HttpPost("run")]\npublic IActionResult Run([FromBody] string cmd) {\n  Process.Start(cmd);\n}\n'),
    )


def test_entries(sample):
    found = {(r.method, r.route) for r in sample.entries.collect()}
    assert {("POST", "/run"), ("GET", "/users/{id}"), ("POST", "/fetch"), ("REQUEST", "x.php"), ("REQUEST", "/proxy"), ("POST", "run")} <= found


def test_no_signals_in_comments_and_strings(sample):
    calm = sample.scopes.where("relative_path = 'calm.js'").first().file_id
    assert sample.signals.where(f"file_id = '{calm}'").isEmpty()


def test_cross_file_path(sample):
    path = next(r for r in sample.paths.collect() if r.files == ["routes/controller.js", "services/service.js", "services/shell.js"])
    assert path.calls == 2 and path.confidence == "high" and path.review_priority == "controls-present" and path.sink.function_name == "executeCommand"
    assert any("import" in s.candidate_reason for s in path.steps if s.kind == "call")


def test_returned_taint(sample):
    path = next(r for r in sample.paths.collect() if r.files[:1] == ["same.js"] and r.calls)
    assert [s.kind for s in path.steps] == ["source", "call", "return", "sink"] and path.steps[2].function_name == "identity" and path.confidence == "medium"


def test_annotation_controls(sample):
    path = next(r for r in sample.paths.collect() if r.files == ["Web/UserController.java"])
    assert path.authorization == 1 and path.steps[1].line == 3


def test_findings(sample):
    rows = {(r.rule_id, r.sink.relative_path): r for r in sample.findings.collect()}
    ssrf = rows["potential-ssrf", "a.py"]
    assert (ssrf.severity, ssrf.confidence, ssrf.sort_score) == ("high", "high", 438) and "BLOCK_PRIVATE_IP" in ssrf.missing
    assert rows["potential-command-injection", "services/shell.js"].path_count == 2


def test_targets(sample):
    rows = {(r.kind, r.relative_path): r for r in sample.targets.collect()}
    assert rows["endpoint", "x.php"].priority == "P0" and rows["endpoint", "x.php"].categories == ["command"]
    assert ("function", "calm.js") not in rows
    assert rows["endpoint", "main.go"].sources == 1 and rows["endpoint", "main.go"].sinks == 1


def test_stable_ids_and_trace(spark):
    text = "function run(req) {\n  exec(req.body.x);\n}\n"
    a, b = build(spark, ("m.js", "javascript", text)), build(spark, ("m.js", "javascript", "\n\n" + text))
    assert a.scopes.first().scope_id == b.scopes.where("not is_global").first().scope_id
    assert a.targets.first().target_id == b.targets.first().target_id and a.targets.first().line != b.targets.first().line
    roles = {(r.line, r.role) for r in a.mentions("/ws/m.js", "req").collect()}
    assert (2, "input") in roles


def test_selected_variable(spark):
    a = build(spark, ("t.js", "javascript", "function go(target) {\n  send(target);\n}\n"), ("u.js", "javascript", "function send(url) {\n  fetch(url);\n}\n"), max_paths=10)
    row = a.trace(absolute_path="/ws/t.js", line=2, identifier="target").first()
    assert row.category == "network" and len(row.files) == 2 and row.source_kind == "SELECTED_SYMBOL" and row.steps[0].label == "Selected variable target"


def test_limits(spark):
    many = "".join(f"function f{i}(req, res) {{\n  const v = req.query.v;\n  res.send(v);\n}}\n" for i in range(80)) + "function g(req) {\n  const v = req.query.v;\n  exec(v);\n}\n"
    a = build(spark, ("many.js", "javascript", many), max_paths=80)
    rows = a.paths.collect()
    assert len(rows) == 80 and a.metadata["truncated"] and a.metadata["total_candidates"] == 81 and rows[0].category == "command"


def recursive_paths(fns, state, depth, most):
    """A direct depth-first walk, to hold the frontier against."""
    fn = fns[state["scope_id"]]
    ended, called = flow.walk(state, fn, depth, most)
    out = list(ended)
    for c in called:
        out += recursive_paths(fns, c, depth + 1, most)
    return sorted(out, key=lambda x: x[0])


def test_frontier_equals_recursion(sample):
    found = flow.functions_with_facts(sample.scopes, sample.operations, sample.resolved, sample.keep)
    fns = {r["scope_id"]: r.asDict(True) for r in found.collect()}
    want = set()
    for r in flow.roots(sample.scopes, sample.operations).collect():
        state = {"root": 0, "trail": [], "scope_id": r.scope_id, "tainted": r.names, "start_line": r.at, "steps": [r.step.asDict(True)], "visited": [flow.visit_key(r.scope_id, r.names)]}
        if r.scope_id in fns:
            want |= {tuple((s["kind"], s["relative_path"], s["line"], s["function_name"]) for s in steps) for _, steps in recursive_paths(fns, state, 0, 6)}
    found = {tuple((s.kind, s.relative_path, s.line, s.function_name) for s in r.steps) for r in sample.paths.collect()}
    assert found == want and len(found) > 5


def test_a_language_can_be_added(spark):
    from auditweave.frontends import BUILT_IN
    from auditweave.functions import columns as C
    from auditweave.operators import views

    ruby = BUILT_IN.extended("ruby", (".rb",), [("source", "Request data", r"\bparams\[", None, False), ("sink", "Command", r"\bsystem\s*\(", "command", False)], [r"^\s*def\s+([a-z_]\w*)\s*\(([^)]*)\)"])
    files = spark.createDataFrame([("/ws/a.rb", "a.rb", "def run(x) {\n  y = params[x];\n  system(y);\n}\n")], "absolute_path string, relative_path string, text string")
    named = files.withColumn("language", C.language_of("relative_path", ruby.extensions))
    a = Audit(named, frontends=ruby)
    assert [r.name for r in a.functions.collect()] == ["run"] and {r.category for r in a.signals.collect()} == {"source", "command"}
    assert [r.category for r in a.paths.collect()] == ["command"] and "ruby" in ruby.languages and "ruby" not in BUILT_IN.languages and "ruby" not in ruby.without("ruby").languages
    assert Audit(named).functions.isEmpty()  # another audit of the session knows nothing of it
    assert [r.kind for r in views.signals_at(a.signals, "/ws/a.rb", 3).collect()] == ["sink"] and views.of_file(a.lines, "/ws/b.rb").isEmpty()
    note = views.evidence_of_selection(files, "/WS/a.rb", 2, 3, "Sink", "see", "2026-01-01").first()
    assert note.code == "y = params[x];\n  system(y);" and (note.line, note.end_line) == (2, 3)
    with pytest.raises(TypeError):
        BUILT_IN.extended("", (), [], [])
    with pytest.raises(TypeError):
        BUILT_IN.extended("empty", ())
    with pytest.raises(ValueError):
        BUILT_IN.extended("x", (), [("odd", "", "a", None, False)], [])


def test_a_language_can_bring_its_parser(spark):
    """A parser gives functions, signals, entries and references; calls, flow and targets go on from there."""
    from auditweave.frontends import BUILT_IN

    def parse(text, path):
        if path == "lib.steps":
            return {"functions": [{"name": "perform", "parameters": ["job"], "line": 1, "end_line": 2}], "signals": [{"line": 2, "kind": "sink", "label": "Synthetic sink", "category": "command", "variables": ["job"]}]}
        return {
            "functions": [{"name": "handler", "parameters": ["payload"], "line": 3, "end_line": 5}],
            "signals": [{"line": 3, "kind": "source", "label": "Synthetic input", "category": "source", "code": "input", "variables": ["payload"]}],
            "entries": [{"line": 4, "method": "post", "route": "/jobs"}],
            "references": [{"local": "perform", "target": "./lib"}],
        }

    steps = BUILT_IN.extended("steps", (".steps",), parse=parse)
    a = build(spark, ("main.steps", "steps", "no syntax\nhere\nat all\nx = 1\nperform(payload)"), ("lib.steps", "steps", "one line"), frontends=steps)
    assert {(r.name, tuple(r.names), r.line, r.end_line) for r in a.functions.collect()} == {("handler", ("payload",), 3, 5), ("perform", ("job",), 1, 2)}
    assert [(r.method, r.route, r.function_name, r.end_line) for r in a.entries.collect()] == [("POST", "/jobs", "handler", 5)]
    assert {(r.label, r.code) for r in a.signals.collect()} == {("Synthetic input", "input"), ("Synthetic sink", "")}
    best = a.paths.first()
    assert [s.kind for s in best.steps] == ["source", "call", "sink"] and best.files == ["main.steps", "lib.steps"] and best.confidence == "high" and best.steps[1].candidate_reason == "import ./lib"
    assert {(r.kind, r.relative_path) for r in a.targets.collect()} == {("endpoint", "main.steps"), ("function", "lib.steps")}


def test_lookups_of_many_identifiers(spark):
    a = build(spark, ("m.js", "javascript", "function go(a, b) {\n  const c = a;\n  if (b) send(c, x.b);\n}\n"), ("n.js", "javascript", "let a = 1;\n"))
    wanted = spark.createDataFrame([("a",), ("b",), ("none",)], "identifier string")
    from auditweave.operators import structure

    found = {(r.identifier, r.line, r.column, r.role) for r in structure.mentions(a.postings, a.lines, a.signals, wanted).collect()}
    assert found == {("a", 1, 13, "parameter"), ("b", 1, 16, "parameter"), ("a", 2, 13, "reference"), ("b", 3, 7, "condition"), ("a", 1, 5, "assignment")}


def test_nested_functions_and_annotations(spark):
    a = build(spark, ("n.js", "javascript", "function outer(x) {\n  function inner(y) {\n    exec(y);\n  }\n}\nexec(z);\n"), ("N.java", "java", '@PreAuthorize("x")\npublic void late(String q) {\n  Runtime.getRuntime().exec(q);\n}\n'))
    from auditweave.operators import structure

    held = {(r.language, r.fn_line, r.line) for r in structure.function_signals(a.functions, a.signals).collect()}
    assert held == {("javascript", 1, 3), ("javascript", 2, 3), ("java", 2, 3), ("java", 2, 1)}
    assert {(r.language, r.line) for r in structure.uncovered(a.signals).collect()} == {("javascript", 6), ("java", 1)}


def same_rows(a, b):
    columns = ["path_id", "category", "confidence", "review_priority", "files", "calls"]
    return [tuple(map(str, r)) for r in a.select(columns).collect()] == [tuple(map(str, r)) for r in b.select(columns).collect()]


def test_best_paths_without_a_cap_equal_walking_all(sample, spark):
    """Branch and bound gives the paths that walking everything gives, and leaves roots unwalked where their bounds allow it."""
    every = flow.paths(sample.scopes, sample.operations, sample.resolved, sample.ranks, sample.keep, max_paths=200)
    bounded = flow.best_paths(sample.scopes, sample.operations, sample.resolved, sample.ranks, sample.bounds, sample.keep, max_paths=200, slice_size=2)
    assert same_rows(every[0], bounded[0]) and bounded[1]["total_candidates"] == every[1]["total_candidates"]
    text = "".join(f"function f{i}(req, res) {{\n  const v = req.query.v;\n  {call};\n}}\n" for i in range(60) for call in ["exec(v)" if i % 6 == 0 else "deep(v)" if i % 6 == 1 else "res.send(v)"])
    text += "function deep(a) {\n  deeper(a);\n}\nfunction deeper(b) {\n  exec(b);\n}\n"
    few = build(spark, ("m.js", "javascript", text), max_paths=8)
    capped = flow.paths(few.scopes, few.operations, few.resolved, few.ranks, few.keep, max_paths=8)[0]
    best, facts = flow.best_paths(few.scopes, few.operations, few.resolved, few.ranks, few.bounds, few.keep, max_paths=8, slice_size=20)
    assert same_rows(capped, best) and facts["roots_walked"] < 60 and facts["truncated"] and not facts["exploration_truncated"]
    few.exhaustive = True
    assert same_rows(few.paths, best)


def test_all_paths_equal_walking_all(sample, spark):
    """Without max_paths nothing is cut or numbered, and paths and findings are those of numbered roots."""
    every = Audit(sample.files, max_paths=None)
    columns = ["path_id", "category", "confidence", "review_priority", "files", "calls", "sink", "steps"]
    rows = lambda df, c: sorted(map(str, df.select(c).collect()))
    assert rows(every.paths, columns) == rows(sample.paths, columns) and every.metadata["total_candidates"] == sample.metadata["total_candidates"] and not every.metadata["truncated"]
    columns = ["finding_id", "rule_id", "sink", "path_ids", "path_count", "sort_score"]
    assert rows(every.findings, columns) == rows(sample.findings, columns)


def test_return_facts_of_a_deep_chain_and_a_cycle(spark):
    """Facts travel up a chain of any depth and around cycles, and a round works on the callers of what changed only."""
    chain = "".join(f"function f{i}(a{i}) {{\n  const r = f{i + 1}(a{i});\n  return r;\n}}\n" for i in range(12)) + "function f12(z) {\n  return z;\n}\n"
    cycle = "function ping(p) {\n  if (p) return pong(p);\n  const q = pong(p);\n  return q;\n}\nfunction pong(s) {\n  const t = ping(s);\n  const u = last(s);\n  return u;\n}\nfunction last(m) {\n  return m;\n}\n"
    root = "function go(req, res) {\n  const v = req.query.v;\n  const w = f0(v);\n  res.send(w);\n}\n"
    a, worked = build(spark, ("c.js", "javascript", chain + root), ("y.js", "javascript", cycle)), []

    def keep(df, name):
        df = a.keep(df, name)
        if name == "fact-callers":
            worked.append(df.count())
        return df

    plain = flow.flow_functions(a.scopes, a.operations, a.resolved)
    facts, _ = flow.return_facts(plain, a.scopes, a.operations, a.resolved, keep)
    names = {r.scope_id: r.name for r in a.scopes.collect()}
    found = {(names[r.scope_id], r.parameter) for r in facts.collect()}
    assert found == {(f"f{i}", f"a{i}") for i in range(12)} | {("f12", "z"), ("ping", "p"), ("pong", "s"), ("last", "m")}
    assert worked[0] <= 14 and max(worked[3:]) <= 2 and len(worked) >= 12
    assert any([s.kind for s in r.steps] == ["source", "call", "return", "sink"] for r in a.paths.collect())


def test_report(sample, spark, tmp_path):
    from auditweave.sources import sessions

    php = sample.targets.where("relative_path = 'x.php'").first().target_id
    statuses = spark.createDataFrame([(php, "reviewed")], "item_id string, status string")
    notes = spark.createDataFrame([("n1", "Sink", "", "a ``` b", "x.php", 1, "2026-01-01")], "id string, type string, note string, code string, relative_path string, line int, created_at string")
    lines = sample.report(statuses, notes, "2026-02-03", incomplete=True, skipped_files=3, scope="current-files")
    said = [r.text for r in lines.collect()]
    n = sample.targets.count()
    assert said[:6] == ["# Audit report", "", "Generated: 2026-02-03", "", "## Review coverage", ""] and f"(1/{n} targets reviewed)" in said[6]
    assert said[7].endswith("lines (**partial index**; workspace-wide indexing has not run; 3 files skipped)") and said[8] == f"- Attack surface: {sample.entries.count()} entry points"
    heads = [x for x in said if x.startswith("## ")]
    assert heads == ["## Review coverage", "## Attack surface", "## Potential findings", "## Review targets", "## Evidence notebook"]
    surface = said[said.index("## Attack surface") : said.index("## Potential findings")]
    assert "- `POST /run` — routes/controller.js:3" in surface
    assert any(x.startswith("- **CRITICAL impact / ") and x.endswith("services/shell.js:3") for x in said)
    at = said.index("- Location: `x.php:1`")
    assert said[at - 2].startswith("### P0 · ") and said[at + 1] == "- Status: **reviewed**" and said[at + 2].startswith("- Review reasons: ") and said[at + 4] == "Checklist:" and said[at + 5].startswith("- [ ] ")
    assert said[said.index("### Sink · x.php:1") :][:7] == ["### Sink · x.php:1", "", "No note", "", "````", "a ``` b", "````"] and said[-3] == "---"
    sessions.write_report(lines, f"file://{tmp_path}/report")
    assert "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))).split("\n")[:-1] == said
