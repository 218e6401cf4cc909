"""Statuses aged in a stream's state hold against the batch reconciliation, run by run."""

import json

from pyspark.sql import functions as F

from auditweave.operators import state
from auditweave.streaming.statuses import Statuses

STATUS = "item_id string, status string, updated_at timestamp, orphaned_at timestamp"


def put(folder, name, *events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(e) + "\n" for e in events))


def status(item, value, day):
    return {"kind": "status", "item_id": item, "status": value, "ts": f"{day}T00:00:00Z"}


def index(day, complete, **items):
    return [*({"kind": "item", "item_id": k, "ts": f"{day}T00:00:00Z", "legacy_ids": v} for k, v in items.items()), *([{"kind": "run", "ts": f"{day}T00:00:00Z"}] if complete else [])]


def told(df):
    return {r.item_id: (r.status, str(r.updated_at), str(r.orphaned_at)) for r in df.collect()}


def test_aging_equals_reconciliation(spark, tmp_path):
    inbox = tmp_path / "in"
    aging = Statuses(spark, str(inbox), f"file://{tmp_path}/state")
    held = spark.createDataFrame([], STATUS)
    set_first = [("old", "reviewed"), ("older", "blocked"), ("gone", "blocked"), ("back", "in_review"), ("both", "reviewed"), ("legacy-both", "blocked")]
    put(inbox, "0", *(status(i, s, "2026-01-01") for i, s in set_first))
    held = held.union(spark.createDataFrame([(i, s) for i, s in set_first], "i string, s string").select("i", "s", F.to_timestamp(F.lit("2026-01-01")), F.lit(None).cast("timestamp")))
    runs = [
        ("2026-01-02", True, {"new": ["old", "older"], "both": ["legacy-both"]}),  # gone and back are missing
        ("2026-01-10", False, {"new": []}),  # some files only: orphans nothing
        ("2026-01-20", True, {"back": [], "new": ["old"], "both": []}),
        ("2026-02-05", True, {"back": [], "new": []}),  # gone for 34 days, both for none yet
    ]
    for n, (day, complete, items) in enumerate(runs, 1):
        put(inbox, str(n), *index(day, complete, **items))
        aging.run()
        table = spark.createDataFrame(list(items.items()), "item_id string, legacy_ids array<string>")
        settled = state.reconcile(held, table, F.to_timestamp(F.lit(day)), complete)
        held = spark.createDataFrame(settled.where("action <> 'removed'").drop("action").collect(), STATUS)
        assert told(aging.current) == told(held), day
    assert told(held).keys() == {"new", "back", "both"} and told(held)["new"][0] == "reviewed"
    actions = {(r.item_id, r.action) for r in aging.log.collect()}
    assert {("new", "migrated"), ("old", "moved"), ("gone", "orphaned"), ("gone", "removed"), ("both", "orphaned")} <= actions
    put(inbox, "9", status("new", "unreviewed", "2026-02-06"))
    aging.run()
    assert told(aging.current).keys() == {"back", "both"}
