import os
import time

from auditweave.sources import datasource, workspace
from auditweave.streaming import live


def write(root, name, text="x = 1"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_folders_are_listed_as_far_as_needed(tmp_path, monkeypatch):
    for a in range(4):
        for b in range(4):
            write(tmp_path, f"d{a}/e{b}/f/g/x{b}.py")
    write(tmp_path, "top.js")
    write(tmp_path, "node_modules/no.js")
    scanned = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: scanned.append(p) or scandir(p))
    few = datasource.dealt({"ws": str(tmp_path)}, 10)
    assert 10 <= len(few) <= 16 and len(scanned) < 6  # the driver doesn't go on below
    monkeypatch.undo()
    for folders in (1, 3, 10, 1000):
        found = [r for part in datasource.dealt({"ws": str(tmp_path)}, folders) for _, r, _ in datasource.walk(part, False, (".py", ".js"))]
        assert sorted(found) == sorted(["top.js", *(f"d{a}/e{b}/f/g/x{b}.py" for a in range(4) for b in range(4))])


def test_several_workspaces_and_the_limit(spark, tmp_path):
    for ws in "ab":
        for n in range(5):
            write(tmp_path / ws, f"s{n}/m{n}.py")
    roots = {"one": str(tmp_path / "a"), "two": str(tmp_path / "b")}
    files, counts = workspace.scan(spark, roots, most=7)
    assert counts == {"discovered": 10, "truncated": True}
    assert sorted(r.relative_path for r in files.collect()) == [f"one/s{n}/m{n}.py" for n in range(5)] + ["two/s0/m0.py", "two/s1/m1.py"]
    assert workspace.scan(spark, {"none": str(tmp_path / "c")})[1] == {"discovered": 0, "truncated": False}


def test_saves_stream_into_the_live_index(spark, tmp_path):
    roots = {"ws": str(tmp_path / "ws")}
    write(tmp_path / "ws", "a.py", "one")
    write(tmp_path / "ws", "lib/b.js", "two")
    index = live.LiveIndex(spark, f"file://{tmp_path}/index")
    sizes = []
    index.rebuild = lambda changed, current: sizes.append(changed.count())
    index.start(workspace.saves(spark, roots), str(tmp_path / "cp")).awaitTermination()
    time.sleep(0.05)
    write(tmp_path / "ws", "lib/b.js", "three")
    write(tmp_path / "ws", "c.go", "four")
    index.start(workspace.saves(spark, roots), str(tmp_path / "cp")).awaitTermination()
    assert {(r.relative_path, r.text, r.language) for r in index.current.collect()} == {("a.py", "one", "python"), ("lib/b.js", "three", "javascript"), ("c.go", "four", "go")}
    assert sizes == [2, 2]
