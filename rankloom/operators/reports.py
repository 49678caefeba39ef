"""Reports over rankings: export rows, detail rows, feature means, histogram, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.jobs import JOB_SCHEMA, JobSpec
from rankloom.operators import topk
from rankloom.operators.reasons import add_reasoning


def shortlist(ranked: DataFrame, k: int = C.TOP_K_EXPORT) -> DataFrame:
    """First ``k`` rows per job with rank and normalised score."""
    order = topk.score_order()
    best = topk.rank_rows(topk.top_k(ranked, k, order, ["jd_id"]), ["jd_id"], order)
    return topk.normalised_score(best, ["jd_id"])


def export_rows(ranked: DataFrame, k: int = C.TOP_K_EXPORT) -> DataFrame:
    """``jd_id, candidate_id, rank, score, reasoning``."""
    rows = add_reasoning(shortlist(ranked, k))
    return rows.select(
        "jd_id", "candidate_id", "rank", topk.format_score(F.col("norm_score")).alias("score"), "reasoning"
    )


DETAIL_COLUMNS = (
    "jd_id candidate_id display_name breakdown matched_skills missing_skills strengths concerns integrity_flags"
).split()


def detail_rows(ranked: DataFrame) -> DataFrame:
    """Everything about a score but the record itself; the composite is called ``score``."""
    return ranked.select(*DETAIL_COLUMNS, F.col("composite_score").alias("score"))


def candidate_lookup(ranked: DataFrame, candidate_id: str | Column) -> DataFrame:
    """The rows of one candidate in a ranking."""
    return ranked.where(F.col("candidate_id") == candidate_id)


def breakdown_long(df: DataFrame, *ids: str) -> DataFrame:
    """One row per breakdown value."""
    flat = df.select(*ids, "breakdown.*")
    return flat.unpivot(list(ids), C.BREAKDOWN, "feature", "value")


def feature_means(ranked: DataFrame, k: int = 20) -> DataFrame:
    """Mean of every breakdown value over the best ``k`` rows per job."""
    best = topk.top_k(ranked, k, topk.score_order(), ["jd_id"])
    means = best.groupBy("jd_id").agg(*[F.avg(F.col("breakdown")[n]).alias(n) for n in C.BREAKDOWN])
    return means.unpivot(["jd_id"], C.BREAKDOWN, "feature", "average_score")


def histogram(df: DataFrame, score: str, bins: int = 20, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins 1..``bins`` between the smallest and largest score of a key.

    One pass over the rows counts each distinct score (partial counts, so a hot job is
    combined before the shuffle); limits and bins come from those few counts alone.
    """
    keys = keys or ["jd_id"]
    counted = df.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    joined = counted.withColumn("_low", F.min(score).over(own)).withColumn("_high", F.max(score).over(own))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width > 0, F.floor((F.col(score) - F.col("_low")) / width) + 1).otherwise(F.lit(1))
    return (
        joined.select(*keys, F.least(place, F.lit(bins)).cast("int").alias("bin"), "_n")
        .groupBy(*keys, "bin")
        .agg(F.sum("_n").alias("n"))
    )


def counts(scored: DataFrame, k: int) -> DataFrame:
    """Rows scored and rows kept per job, from partial counts."""
    return scored.groupBy("jd_id").agg(F.count("*").alias("n_scored")).withColumn(
        "n_kept", F.least(F.col("n_scored"), F.lit(k).cast("long"))
    )


def explanation_lookup(ranked: DataFrame, explanations: DataFrame, position: str) -> DataFrame:
    """Ranked rows with the last explanation given for their id, if any."""
    last = explanations.groupBy("candidate_id").agg(
        F.max_by(F.struct(*[c for c in explanations.columns if c not in ("candidate_id", position)]), position).alias("explanation")
    )
    return ranked.join(last, "candidate_id", "left")


PAYLOAD_FIELDS = (
    "candidate_id",
    "display_name",
    "composite_score",
    "breakdown",
    "matched_skills",
    "missing_skills",
    "strengths",
    "concerns",
    "integrity_flags",
)


def _payload() -> Column:
    return F.struct(*PAYLOAD_FIELDS, F.col("reasoning").alias("scoring_reasoning"))


def explanation_payload(details: DataFrame) -> DataFrame:
    """Request rows for an explanation service: one compact JSON text per row."""
    return details.select("jd_id", "candidate_id", F.to_json(_payload()).alias("payload"))


def explanation_requests(details: DataFrame, jobs: list[JobSpec], k: int = C.TOP_K_EXPORT) -> DataFrame:
    """One request per job: ``jd_id, n_candidates, request``, the job and its best ``k`` rows in order, as compact JSON.

    ``details`` are ranked rows with details; reasons are written for the kept rows only.  A job without rows has a request with an empty list.  The job
    record is a literal (null fields stay), so the only shuffle moves at most ``k`` rows per job, and a request holds at most ``k`` of them.
    """
    spark = details.sparkSession
    order = topk.score_order()
    best = add_reasoning(topk.rank_rows(topk.top_k(details, k, order, ["jd_id"]), ["jd_id"], order))
    listed = best.groupBy("jd_id").agg(F.array_sort(F.collect_list(F.struct("rank", _payload().alias("body")))).alias("_rows"))
    known = spark.createDataFrame([{"jd_id": j.jd_id, "_job": j.as_dict()} for j in jobs], f"jd_id string, _job {JOB_SCHEMA.simpleString()}")
    rows = known.join(listed, "jd_id", "left")
    rows = rows.withColumn("_rows", F.coalesce("_rows", F.array().cast(listed.schema["_rows"].dataType)))
    body = F.struct(F.col("_job").alias("jd_intelligence"), F.transform("_rows", lambda r: r["body"]).alias("ranked_candidates"))
    request = F.to_json(body, {"ignoreNullFields": "false"})
    return rows.select("jd_id", F.size("_rows").cast("long").alias("n_candidates"), request.alias("request"))
