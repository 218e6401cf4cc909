import json

import pytest
from pyspark.sql import functions as F

from auditweave.operators import state
from auditweave.sources import sessions, workspace
from auditweave.storage import stored
from auditweave.streaming import live

STATUS = "item_id string, status string, updated_at timestamp, orphaned_at timestamp"


def rows(spark, *items):
    return spark.createDataFrame(items, "item_id string, status string, updated string, orphaned string").select("item_id", "status", F.to_timestamp("updated").alias("updated_at"), F.to_timestamp("orphaned").alias("orphaned_at"))


def test_reconcile(spark):
    statuses = rows(spark, ("old", "reviewed", "2026-08-01", None), ("gone", "blocked", "2026-08-01", None), ("late", "reviewed", "2026-01-01", "2026-07-01"), ("back", "in_review", "2026-08-01", "2026-08-02"))
    items = spark.createDataFrame([("new", ["old"]), ("back", [])], "item_id string, legacy_ids array<string>")
    now = F.to_timestamp(F.lit("2026-08-21"))
    out = {r.item_id: r for r in state.reconcile(statuses, items, now, True).collect()}
    assert {k: r.action for k, r in out.items()} == {"new": "migrated", "gone": "orphaned", "late": "removed", "back": "kept"}
    assert out["back"].orphaned_at is None and out["gone"].orphaned_at is not None
    partial = {r.item_id: r.action for r in state.reconcile(statuses, items, now, False).collect()}
    assert partial["gone"] == "kept" and partial["late"] == "kept"


def test_status_and_coverage(spark):
    statuses = rows(spark, ("a", "reviewed", "2026-08-01", None), ("x", "blocked", "2026-08-01", None))
    items = spark.createDataFrame([("a", []), ("b", ["x"]), ("c", [])], "item_id string, legacy_ids array<string>")
    c = state.coverage(state.with_status(items, statuses)).first()
    assert (c["items"], c.reviewed, c.blocked, c.unreviewed, c.coverage) == (3, 1, 1, 1, 33)
    assert state.coverage(state.with_status(items.limit(0), statuses)).first().coverage == 0
    changed = state.set_status(statuses, "b", "in_review", "2026-08-03", ["x"])
    assert {r.item_id for r in changed.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        state.set_status(statuses, "b", "odd", "2026-08-03")


def test_changes_and_invalidation(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2)], "id string, fingerprint int")
    after = spark.createDataFrame([("b", 3), ("c", 1)], "id string, fingerprint int")
    assert {(r.id, r.change) for r in state.changed_keys(before, after, "id").collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}
    pairs = "file string, function_id string"
    owns = spark.createDataFrame([("service", "s"), ("controller", "c"), ("routes", "r")], pairs)
    depends = spark.createDataFrame([("controller", "s"), ("routes", "c"), ("service", "r")], pairs)
    found = state.affected_files(owns.where("file = 'service'"), owns, depends, stored)
    assert {r.file for r in found.collect()} == {"service", "controller", "routes"}


def test_sessions(spark):
    evidence = spark.createDataFrame([("n1", "Observation", "note", "code", "a.js", "/ws/a.js", 3, 4, "2026-08-01")], "id string, type string, note string, code string, relative_path string, absolute_path string, line int, end_line int, created_at string")
    text = sessions.export(rows(spark, ("t1", "reviewed", "2026-08-01", "2026-08-05")), evidence.withColumn("audit_item_id", F.lit("item")), "2026-08-21").first().json
    payload = json.loads(text)
    assert "absolutePath" not in text and payload["statuses"]["t1"]["status"] == "reviewed"
    payload["evidence"] += [{"id": "n2", "relativePath": "../../etc/passwd"}, {"id": "n3", "relativePath": "b.js", "type": "odd", "line": -1}]
    payload["statuses"]["t2"] = {"status": "odd"}
    statuses, notes = sessions.parse(spark, json.dumps(payload), {"ws": "/ws"})
    assert [r.item_id for r in statuses.collect()] == ["t1"]
    back = json.loads(sessions.export(statuses, notes, "2026-08-21").first().json)
    assert back["statuses"]["t1"] == payload["statuses"]["t1"] and {n["id"]: n.get("auditItemId") for n in back["evidence"]}["n1"] == "item"
    assert {n["id"]: n["createdAt"] for n in back["evidence"]} == {"n1": "2026-08-01", "n3": "1970-01-01T00:00:00.000Z"}
    got = {r.id: r for r in notes.collect()}
    assert set(got) == {"n1", "n3"} and got["n3"].type == "Observation" and (got["n3"].line, got["n3"].end_line) == (1, 1)
    twice = sessions.export(rows(spark, ("t1", "reviewed", "2026-08-01", None), ("t1", "blocked", "2026-08-02", None)), evidence.limit(0), "2026-08-21").first().json
    assert json.loads(twice)["statuses"]["t1"]["status"] == "blocked"
    for bad in ('{"version": 99}', "nonsense"):
        with pytest.raises(ValueError):
            sessions.parse(spark, bad, {"ws": "/ws"})


def test_workspace_scan(spark, tmp_path):
    for name, text in (("a.py", "x = 1"), ("__init__.py", ""), ("node_modules/b.js", "x"), ("big.js", "x" * 50), ("c.md", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files, counts = workspace.scan(spark, {"ws": str(tmp_path)}, largest=40)
    got = {r.relative_path: r for r in files.collect()}
    assert set(got) == {"a.py", "__init__.py", "big.js"} and got["big.js"].error == "too large" and got["a.py"].language == "python"
    assert counts == {"discovered": 3, "truncated": False}
    assert workspace.scan(spark, {"ws": str(tmp_path)}, most=2)[1]["truncated"]
    assert workspace.one(spark, {"ws": str(tmp_path)}, str(tmp_path / "a.py")).first().text == "x = 1"
    assert all(workspace.one(spark, {"ws": str(tmp_path)}, str(p), largest=40).isEmpty() for p in (tmp_path / "big.js", tmp_path / "none.js", tmp_path / "c.md", "/etc/passwd"))
    assert workspace.resolve({"a": "/x", "b": "/y"}, "b/z.js") == "/y/z.js" and workspace.resolve({"a": "/x", "b": "/y"}, "z.js") is None and workspace.resolve({"a": "/x"}, "../z") is None


def change(path, version, op, second, text=None):
    return {"absolute_path": path, "relative_path": path, "language": "python", "text": text or f"v{version}", "version": version, "op": op, "ts": f"2026-01-01T00:{second // 60:02}:{second % 60:02}Z"}


def write_changes(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_live_index(spark, tmp_path):
    folder = tmp_path / "in"
    write_changes(folder, 1, change("/a.py", 2, "save", 2), change("/a.py", 1, "save", 1), change("/b.py", 1, "create", 1))
    index = live.LiveIndex(spark, f"file://{tmp_path}/index")
    index.start(live.changes(spark, str(folder)), str(tmp_path / "cp")).awaitTermination()
    assert {(r.absolute_path, r.text) for r in index.current.collect()} == {("/a.py", "v2"), ("/b.py", "v1")}
    write_changes(folder, 2, change("/b.py", 2, "delete", 60), change("/c.py", 1, "create", 60), change("/a.py", 1, "save", 90, "late and old"))
    index = live.LiveIndex(spark, f"file://{tmp_path}/index")  # a restart
    assert list(index.done.values()) == [0]
    index.start(live.changes(spark, str(folder)), str(tmp_path / "cp")).awaitTermination()
    assert {(r.absolute_path, r.text) for r in index.current.collect()} == {("/a.py", "v2"), ("/c.py", "v1")}
    stream, number = next(iter(index.done.items()))
    index.apply(index.current.limit(0), number, stream)  # comes again
    assert {r.absolute_path for r in live.LiveIndex(spark, f"file://{tmp_path}/index").current.collect()} == {"/a.py", "/c.py"}

    def fail(changed, current):
        raise RuntimeError("no")

    index.rebuild, held = fail, dict(index.parts)
    with pytest.raises(RuntimeError):
        index.apply(index.current, number + 1, stream)
    assert index.parts == held and live.LiveIndex(spark, f"file://{tmp_path}/index").parts == held


def test_live_index_takes_a_new_checkpoint_and_a_second_stream(spark, tmp_path):
    index = live.LiveIndex(spark, f"file://{tmp_path}/index")
    write_changes(tmp_path / "in", 1, change("/a.py", 1, "save", 1))
    index.start(live.changes(spark, str(tmp_path / "in")), str(tmp_path / "cp1")).awaitTermination()
    write_changes(tmp_path / "in", 2, change("/b.py", 1, "save", 2))
    index.start(live.changes(spark, str(tmp_path / "in")), str(tmp_path / "cp1")).awaitTermination()
    write_changes(tmp_path / "in", 3, change("/c.py", 1, "save", 3))
    index.start(live.changes(spark, str(tmp_path / "in")), str(tmp_path / "cp2")).awaitTermination()  # numbers start at 0 again
    write_changes(tmp_path / "other", 1, change("/d.py", 1, "save", 4))
    index.start(live.changes(spark, str(tmp_path / "other")), str(tmp_path / "cp3")).awaitTermination()
    assert {r.absolute_path for r in live.LiveIndex(spark, f"file://{tmp_path}/index").current.collect()} == {"/a.py", "/b.py", "/c.py", "/d.py"} and len(index.done) == 3


def test_live_index_writes_what_changes(spark, tmp_path):
    """Parts hold their batch's rows; merges keep few parts; deleted files and replaced parts leave."""
    index = live.LiveIndex(spark, f"file://{tmp_path}/index")
    frame = lambda *rows: spark.read.schema(live.CHANGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    index.apply(frame(*(change(f"/f{i}.py", 1, "save", 1) for i in range(300))), 0, "s")
    first = next(iter(index.parts))
    want = {f"/f{i}.py": "v1" for i in range(300)}
    for n in range(1, 9):
        index.apply(frame(change(f"/f{n}.py", 2, "save", 10 + n), change(f"/F{n + 100}.py", 2, "delete", 10 + n)), n, "s")
        want[f"/f{n}.py"] = "v2"
        del want[f"/f{n + 100}.py"]
        if n == 1:
            assert [r for _, r in index.parts.values()] == [300, 2]
    assert {r.absolute_path: r.text for r in index.current.collect()} == want
    assert len(index.parts) <= 4 and first not in index.parts
    index.vacuum()
    again = live.LiveIndex(spark, f"file://{tmp_path}/index")
    assert {r.absolute_path: r.text for r in again.current.collect()} == want and again.parts == index.parts


def test_live_index_refuses_a_log_it_cannot_read(spark, tmp_path):
    (tmp_path / "index" / "log").mkdir(parents=True)
    (tmp_path / "index" / "log" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        live.LiveIndex(spark, f"file://{tmp_path}/index")


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from auditweave import storage

    unset = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, master=master, applicationId="x"), conf={})
    assert storage.shared_dir(unset("local[2]")) == storage.shared_dir(unset("local[2]")) != ""
    with pytest.raises(ValueError):
        storage.shared_dir(unset("spark://host:7077"))


def test_cache_of_files(spark):
    record = "file string, version int, functions array<struct<id:string,fingerprint:int>>, dependencies array<string>"
    old = spark.createDataFrame([("service", 1, [("s", 1), ("t", 1)], []), ("controller", 1, [("c", 1)], ["s"]), ("routes", 1, [("r", 1)], ["c", "c"])], record)
    hit, changed = state.update_cache(old, old.where("file = 'service'"))
    assert changed.isEmpty() and hit.count() == 3
    new = spark.createDataFrame([("service", 2, [("s", 2), ("t", 1)], [])], record)
    records, changed = state.update_cache(old, new)
    assert [tuple(r) for r in changed.collect()] == [("service", "s")]
    assert {r.file for r in state.affected_files(changed, *state.cache_tables(records), stored).collect()} == {"service", "controller", "routes"}
    left, gone = state.remove_cached(records, "controller")
    assert {r.function_id for r in gone.collect()} == {"c"} and left.count() == 2
    assert {tuple(r) for r in state.cache_snapshot(records).collect()} == {("service", 2, 2, 0), ("controller", 1, 1, 1), ("routes", 1, 1, 1)}


def test_focus_and_status_at_a_place(spark):
    statuses = rows(spark, ("a", "reviewed", "2026-08-01", None))
    items = spark.createDataFrame([("a", []), ("b", [])], "item_id string, legacy_ids array<string>")
    opened = {r.item_id: r.status for r in state.focus(items, statuses, "b", "2026-08-02").collect()}
    assert opened == {"a": "reviewed", "b": "in_review"} and state.focus(items, statuses, "a", "2026-08-02").collect() == statuses.collect()
    targets = spark.createDataFrame([("t1", "l1", "/ws/a.js", 1, 20), ("t2", "l2", "/ws/a.js", 5, 9)], "target_id string, legacy_id string, absolute_path string, line int, end_line int")
    at = state.set_status_at(targets, statuses, "/WS/a.js", 6, "blocked", "2026-08-02")
    assert {(r.item_id, r.status) for r in at.collect()} == {("a", "reviewed"), ("t2", "blocked")}
    assert state.set_status_at(targets, statuses, "/ws/a.js", 60, "blocked", "2026-08-02").count() == 1


def test_focus_at_a_place_indexes_again_if_nothing_is_there(spark):
    statuses = rows(spark, ("l2", "blocked", "2026-08-01", None))
    columns = "target_id string, legacy_id string, absolute_path string, line int, end_line int"
    targets, later = spark.createDataFrame([("t1", "l1", "/ws/a.js", 1, 20)], columns), spark.createDataFrame([("t1", "l1", "/ws/a.js", 1, 20), ("t2", "l2", "/ws/a.js", 30, 40)], columns)
    asked = []
    reindex = lambda: asked.append(1) or later
    opened, row = state.focus_at(targets, statuses, "/WS/a.js", 5, "2026-08-02", reindex)
    assert row.target_id == "t1" and not asked and {(r.item_id, r.status) for r in opened.collect()} == {("l2", "blocked"), ("t1", "in_review")}
    opened, row = state.focus_at(targets, statuses, "/ws/a.js", 35, "2026-08-02", reindex)
    assert row.target_id == "t2" and asked == [1] and opened.collect() == statuses.collect()  # it has a status by its legacy id
    assert state.focus_at(targets, statuses, "/ws/a.js", 90, "2026-08-02", reindex)[1] is None and state.focus_at(targets, statuses, "/ws/a.js", 90, "2026-08-02")[1] is None
