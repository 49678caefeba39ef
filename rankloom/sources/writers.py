"""Sinks: the ranked CSV and the structured job file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.jobs import JOB_SCHEMA, JobSpec

EXPORT_COLUMNS = ["candidate_id", "rank", "score", "reasoning"]


def write_ranked_csv(export: DataFrame, path: str) -> None:
    """Ranked rows as one CSV with doubled quotes; an export holds at most K rows per job."""
    rows = export.orderBy("jd_id", "rank").select(*EXPORT_COLUMNS).coalesce(1)
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_frame_jobs(jobs: DataFrame, path: str) -> None:
    """Structured jobs of a table as JSON documents, one file per job."""
    jobs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path, ignoreNullFields=False)


def write_jobs(spark: SparkSession, jobs: list[JobSpec], path: str) -> None:
    """Structured jobs as JSON documents for ``readers.read_jobs``."""
    write_frame_jobs(spark.createDataFrame([j.as_dict() for j in jobs], JOB_SCHEMA), path)
