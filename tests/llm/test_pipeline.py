import pyarrow as pa

import corpus_pipeline
from auditweave.llm import jaccard
from auditweave.llm.common import WordHashes, stored, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF), name)
        assert after.columns == docs.columns and after.schema == docs.schema
        assert 0 < after.count() <= before.count()
        if name == "near_duplicates":
            hashes = WordHashes()
            seen: dict = {}
            for r in after.collect():
                found = jaccard.shingles(r.text, hashes)
                if len(found):
                    assert seen.setdefault(found.tobytes(), r.doc_id) == r.doc_id
        if name == "personal_data":
            assert after.where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").isEmpty()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_odd_inputs(spark, odd_docs, no_docs):
    """Columns of any names come through the first four stages as they were, and rows only go where a stage may drop them."""
    named = odd_docs.withColumnsRenamed({"component": "_quality", "rep": "_toxicity", "hi": "_evidence", "source": "_doc"})
    for docs in (named, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, out = out, stored(stage(spark, out, SF), f"odd-{name}")
            assert out.schema == before.schema and out.count() <= before.count()
            if name == "personal_data":
                assert out.count() == before.count()
        held = {r.doc_id: r for r in out.collect()}
        if docs is named:
            assert held[4].text is None and held[13]._quality == "c" and held[13]._toxicity == 1 and held[13]._evidence == 2 and len(held[8].text) > 100_000 and (1 in held) + (2 in held) == 1
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
        assert {r.doc_id for r in pieces} == set(held) and {r.doc_tokens for r in pieces if r.doc_id in (4, 5)} <= {1}


def test_stages_read_small_batches(spark):
    """Executors hold a few MB of a stage's texts at a time, whatever a partition has; a limit that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(12).selectExpr("id AS doc_id", "repeat('wort ', 200000) AS text").coalesce(1)
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())}) for batch in batches)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage, corpus_pipeline.near_duplicates_stage, corpus_pipeline.personal_data_stage, corpus_pipeline.packing_stage):
        spark.conf.unset(key)
        stage(spark, table(spark, SF, "documents").limit(0), SF)
        assert max(r.n for r in texts.mapInArrow(rows, "n long").collect()) <= 5
    spark.conf.set(key, "1m")
    corpus_pipeline.packing_stage(spark, texts, SF)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
