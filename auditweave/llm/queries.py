"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import ann, bpe, centroids, collocations, embed_dedup, exact_dedup, jaccard, packing, pii, quality, secrets, toxicity, url_filter
from auditweave.llm.common import id_bucket, table


def op1_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digested(secrets.scan(table(spark, sf_dir, "documents")))


def op2_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", lambda doc_id: id_bucket(doc_id, 5) != 0)
    held_out = (id_bucket("doc_id", 5) == 0).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_block_max_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", lambda doc_id: id_bucket(doc_id, 4) != 2)
    held_out = (id_bucket("doc_id", 4) == 2).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op5_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op7_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), bpe.default_vocabulary()
    return bpe.encode(docs, vocabulary, bpe.build_lexicon(docs, vocabulary), keep_ids=False)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.default_vocabulary()).drop("ids")


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digested(pii.extract(table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_trigram_secrets": op1_trigram_secrets,
    "op2_spherical_cap_dedup": op2_spherical_cap_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_block_max_neighbours": op4_block_max_neighbours,
    "op5_cross_polytope_neighbours": op5_cross_polytope_neighbours,
    "op6_url_filters": op6_url_filters,
    "op7_bayesian_jaccard_join": op7_bayesian_jaccard_join,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_bootstrapped_pii": op10_bootstrapped_pii,
    "op11_collocations": op11_collocations,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op1_trigram_secrets": secrets.sql(),
    "op2_spherical_cap_dedup": embed_dedup.SQL,
    "op6_url_filters": url_filter.sql(),
    "op11_collocations": collocations.sql(),
    "op12_centroid_clustering": centroids.sql(),
    "op13_exact_dedup": exact_dedup.SQL,
}
