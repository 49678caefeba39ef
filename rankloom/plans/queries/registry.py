"""Query registry and the shared base plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import features
from rankloom.operators.profile import profiles_from_columns
from rankloom.operators.schema_map import SchemaMap
from rankloom.plans import candidates as view
from rankloom.plans.fixtures import CANDIDATE_JOBS, JD_DOC, JD_STAR
from rankloom.plans.ranking import keep_best, score_all
from rankloom.session import shared_dir
from rankloom.sources.readers import spread_small_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ALL_ROWS = 500  # default size of the feature shortlist


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r6(col) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def joined(col, sep: str = "|") -> Column:
    return F.array_join(col, sep)


table = view.load


@lru_cache(maxsize=64)
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Plans, not data: a base plan is built once per session and data folder and shared.


@lru_cache(maxsize=64)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.candidates(spark, sf_dir)


@lru_cache(maxsize=64)
def candidates_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(candidates(spark, sf_dir))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table that one query reads more than once: computed once, into a folder of its own."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_profiles(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return profiles_from_columns(rows, schema_map(spark, sf_dir), record=view.RECORD, keep=("key",))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.to_json(F.struct(*view.RECORD), {"ignoreNullFields": "false"}).alias("raw"))


@lru_cache(maxsize=64)
def schema_map(spark: SparkSession, sf_dir: str) -> SchemaMap:
    return SchemaMap.from_struct(spark, candidates(spark, sf_dir).select(*view.RECORD).schema)


@lru_cache(maxsize=64)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_profiles(spark, sf_dir, candidates(spark, sf_dir))


@lru_cache(maxsize=64)
def with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_role_tokens(features.add_tokens(profiles(spark, sf_dir)))


@lru_cache(maxsize=64)
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_all(profiles(spark, sf_dir), CANDIDATE_JOBS)


@lru_cache(maxsize=64)
def scored_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_all(profiles(spark, sf_dir), [JD_STAR])


@lru_cache(maxsize=64)
def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_details(scored(spark, sf_dir))


@lru_cache(maxsize=64)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_best(scored(spark, sf_dir), ALL_ROWS, keep=("key",))


@lru_cache(maxsize=64)
def documents_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text")
    paths = SchemaMap.from_struct(spark, docs.schema)
    return score_all(profiles_from_columns(docs, paths, record=["id", "text"]), [JD_DOC])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query derives from the tables."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
