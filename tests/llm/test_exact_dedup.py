import hashlib
import random
from pathlib import Path

import pytest

from auditweave.llm import exact_dedup

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    """rows (doc_id, text): what the operator returns, for ids that differ."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted(((i, (best := max(g, key=key)), len(g), i == best, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=str)


def told(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def write(spark, rows, path, files=1, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, file string, row long").repartition(files).write.mode(mode).parquet(path)


@pytest.mark.parametrize("bits", [256, 4])
def test_equals_brute_force_also_where_texts_share_digests(spark, tmp_path, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice([None, "", " ", "a", "A", "é", "é", "x" * 50_000, f"t{rng.randrange(30)}"])) for i in range(300)]
    write(spark, [(*r, "clash", 7) for r in rows], f"{tmp_path}/docs", 5)
    assert told(exact_dedup.deduplicate(spark, f"{tmp_path}/docs", digest_bits=bits)) == brute(rows)


def test_goes_on_where_it_stopped(spark, tmp_path, bits=4):
    docs, work, rows = f"{tmp_path}/docs", f"file://{tmp_path}/work", []
    for round_ in range(2):
        new = [(100 * round_ + i, f"t{(i * 7 + round_) % 23}") for i in range(40)]
        rows += new
        write(spark, [(*r, "", 0) for r in new], docs, 3)
        found = exact_dedup.deduplicate(spark, docs, work=work, files_per_batch=2, digest_bits=bits)
        assert told(found) == brute(rows)
    assert told(exact_dedup.deduplicate(spark, docs, work=work, digest_bits=bits)) == brute(rows)  # nothing new


def test_null_and_repeated_ids_leave_one_row(spark, tmp_path):
    write(spark, [(1, "a", "", 0), (1, "a", "", 0), (None, "a", "", 0), (None, "b", "", 0), (None, None, "", 0), (2, "", "", 0)], f"{tmp_path}/docs")
    found = exact_dedup.deduplicate(spark, f"{tmp_path}/docs").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == [("1", "1", 3), ("1", "1", 3), ("2", "2", 2), ("None", "1", 3), ("None", "2", 2), ("None", "None", 1)]
    assert sum(r.kept for r in found) == 3


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    assert exact_dedup.deduplicate(spark, f"{tmp_path}/docs").collect() == []


def test_state_is_on_disk_without_expiry(spark, tmp_path):
    assert exact_dedup.ROCKSDB["spark.sql.streaming.stateStore.providerClass"].endswith("RocksDBStateStoreProvider")
    write(spark, [(1, "a", "", 0), (2, "b", "", 0), (3, "a", "", 0)], f"{tmp_path}/docs")
    exact_dedup.deduplicate(spark, f"{tmp_path}/docs", work=f"file://{tmp_path}/work").collect()
    state = spark.read.format("statestore").load(f"file://{tmp_path}/work/state-checkpoint").selectExpr("key.key as key").collect()
    assert {r.key for r in state} == {hashlib.sha256(t).hexdigest() for t in (b"a", b"b")}


def test_stores_take_disk_for_what_they_hold(spark, tmp_path):
    """A store a partition: none has space set aside, so many partitions do not fill the disk."""
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    before, parts = set(local.rglob("MANIFEST-*")), spark.conf.get("spark.sql.shuffle.partitions")
    write(spark, [(k, f"t{k}", "", 0) for k in range(100)], f"{tmp_path}/docs")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        exact_dedup.members_of(spark, f"{tmp_path}/docs").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    taken = [512 * p.stat().st_blocks for p in set(local.rglob("MANIFEST-*")) - before]
    assert len(taken) >= 12 and max(taken) < 1 << 20
