"""The operators' registered queries; __spark_entry__.py adds them if this folder is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe, centroids, divergence, language_model, licenses, mixing, near_copies, nearest, pii, quality_model, quality_rules, secret_scan, spot_signatures
from rankloom.llm.common import table

try:  # the vocabulary files' folder is the box's; the path is a parameter everywhere else
    from public_tokenizers import path as vocabulary_path
except ModuleNotFoundError:

    def vocabulary_path(name: str) -> str:
        return f"/opt/tokenizers/{name}"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_report(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality_model": op2_quality_model,
    "op3_pii": op3_pii,
    "op4_nearest": op4_nearest,
    "op5_bpe": op5_bpe,
    "op6_licenses": op6_licenses,
    "op7_near_copies": op7_near_copies,
    "op8_secrets": op8_secrets,
    "op9_language_model": op9_language_model,
    "op10_quality_rules": op10_quality_rules,
    "op11_spot_signatures": op11_spot_signatures,
    "op12_divergence": op12_divergence,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op10_quality_rules": quality_rules.SQL,
    "op12_divergence": divergence.SQL,
    "op13_centroids": centroids.oracle_sql(),
}
