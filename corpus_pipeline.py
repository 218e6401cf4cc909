"""The training-data pipeline: five stages over documents, each writing what the next one reads.

1. quality: documents that the quality classifier rejects go.
2. toxicity: documents that the neighbours' votes call toxic go.
3. near_duplicates: one document of each group stays, the one with the smallest id.
4. personal_data: e-mail addresses, IPs, cards, phones and discovered identifiers are replaced by their kind.
5. packing: the remaining documents' tokens, packed into windows.

The first four return the columns of their input; the last returns the packed pieces. Labels of held-out rows (by id, as
in the registered queries) are never used for training.

Defined results: null texts count as empty ones and stay null; rows with a null id are scored, and each stays unless its score
rejects it; repeated rows are one group of copies; extra columns of any names come through as they are; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import bpe, jaccard, packing, pii, quality, toxicity
from auditweave.llm.common import free_name, id_bucket, small_batches, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", lambda doc_id: id_bucket(doc_id, 5) != 0)
    score = free_name(docs, "_quality")
    return quality.score(docs, model, output=score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", lambda doc_id: id_bucket(doc_id, 4) != 2)
    score, evidence = free_name(docs, "_toxicity"), free_name(docs, "_evidence")
    return toxicity.score(docs, model, output=score, evidence=evidence).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The first two stages learn models, so SQL can't express the result; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}-{name}")
    return docs
