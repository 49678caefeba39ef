"""The ranking plan: score every record against every job, keep the best, explain them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import constants as C
from rankloom.jobs import JobSpec, job_batches
from rankloom.operators import features, reports, topk
from rankloom.operators.profile import DEFAULT_SIGNALS_FIELD, profiles_from_columns, profiles_from_json
from rankloom.operators.schema_map import SchemaMap
from rankloom.session import shared_dir
from rankloom.sources.readers import PLACE, line_offsets, number_lines, read_jsonl, read_lines

#: Begins the stand-in for a line number; no id of a record starts with it.
PLACE_MARK = "\x00line "

# what the shortlist needs later; text and token arrays stay behind in the scan stage
CARRIED = (
    "jd_id candidate_id display_name title headline reason_title reason_location profile_years "
    "listed_skills has_profile signals signal_keys jd required_scores preferred_scores integrity_flags "
    "semantic_match lexical_relevance skill_overlap_score required_coverage preferred_coverage skill_depth "
    "role_fit experience_score production_score seniority_score career_score behavioral_score "
    "availability_score education_score location_score integrity_score evidence_confidence technical_fit "
    "role_relevance hireability must_have_gate composite_score"
).split()


@dataclass(frozen=True)
class RankingResult:
    """DataFrames of one ranking; nothing has run until one of them is used."""

    schema_map: SchemaMap
    jobs: list[JobSpec]
    scored: DataFrame
    ranked: DataFrame
    export: DataFrame


def score_all(profiles: DataFrame, jobs: list[JobSpec]) -> DataFrame:
    """Scores of every profile for every job; large job lists take several passes."""
    if not jobs:  # an empty ranking with the usual columns
        return features.score(profiles, [JobSpec()]).limit(0)
    return reduce(DataFrame.unionByName, [features.score(profiles, batch) for batch in job_batches(jobs)])


def keep_best(scored: DataFrame, k: int, tie_break: str = topk.BY_ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best ``k`` rows per job, with breakdown, matched terms, strengths and concerns."""
    narrow = scored.select(*keep, *CARRIED)
    best = topk.top_k(narrow, k, topk.score_order(tie_break=tie_break), ["jd_id"])
    return features.add_details(best)


#: Ids of the cut are broadcast up to this many (some 10 MB); beyond, Spark joins them as it joins any table.
MAX_CUT_IDS = 200_000


def retrieval_scores(profiles: DataFrame, jobs: list[JobSpec]) -> DataFrame:
    """``candidate_id, jd_id, score``: narrow rows of the retrieval score, one per job where it is a map."""
    if not isinstance(profiles.schema["retrieval_score"].dataType, T.MapType):
        return profiles.select("candidate_id", F.lit("").alias("jd_id"), F.col("retrieval_score").cast("double").alias("score"))
    pairs = profiles.select("candidate_id", F.explode("retrieval_score").alias("jd_id", "score"))
    return pairs.where(F.col("jd_id").isin([j.jd_id for j in jobs])).withColumn("score", F.col("score").cast("double"))


def retrieval_cut(profiles: DataFrame, jobs: list[JobSpec], k: int) -> DataFrame:
    """Profiles that may be among the best ``k`` of some job: those whose id is.

    Ids and scores are written once to the shared folder; the k-th scores are found there by counting.  The ids
    that are left filter the profiles before anything else of them is computed.
    """
    spark = profiles.sparkSession
    path = f"{shared_dir(spark)}/retrieval-{uuid.uuid4().hex}"
    retrieval_scores(profiles, jobs).write.parquet(path)
    best = topk.select_k(spark.read.parquet(path), k, "score", "candidate_id", ["jd_id"])
    ids = best.select("candidate_id").distinct()
    ids = F.broadcast(ids) if k * max(1, len(jobs)) <= MAX_CUT_IDS else ids
    return profiles.join(ids, "candidate_id", "left_semi")


def settled_cut(scored: DataFrame, k: int) -> DataFrame:
    """Exactly the best ``k`` rows per job by retrieval score; ids may repeat, so the cut by id may hold more."""
    given = F.col("retrieval_score")
    if isinstance(scored.schema["retrieval_score"].dataType, T.MapType):
        given = F.try_element_at(given, F.col("jd_id"))
        scored = scored.where(given.isNotNull())
    scored = scored.withColumn("_given", topk.comparable(given))
    return topk.top_k(scored, k, topk.score_order("_given"), ["jd_id"]).drop("_given")


def rank(
    profiles: DataFrame,
    jobs: JobSpec | list[JobSpec],
    schema_map: SchemaMap | None = None,
    *,
    k_retrieval: int | None = None,
    k_features: int = C.TOP_K_FEATURES,
    k_export: int = C.TOP_K_EXPORT,
    tie_break: str = topk.BY_ID,
    keep: tuple[str, ...] = (),
) -> RankingResult:
    """Rank profile rows.

    ``k_retrieval`` first cuts every job to its best rows by the ``retrieval_score`` column:
    one score for all jobs, or a map from job id to score.  The cut is made at once, on ids and scores
    alone; only rows that some job keeps are scored.
    """
    jobs = [jobs] if isinstance(jobs, JobSpec) else list(jobs)
    if k_retrieval is not None:
        profiles = retrieval_cut(profiles, jobs, k_retrieval)
    scored = score_all(profiles, jobs)
    if k_retrieval is not None:
        scored = settled_cut(scored.select(*keep, *[c for c in ("retrieval_score",) if c not in keep], *CARRIED), k_retrieval)
    ranked = keep_best(scored, k_features, tie_break, keep)
    return RankingResult(
        schema_map or SchemaMap(), jobs, scored, ranked, reports.export_rows(ranked, k_export)
    )


def write_ranking(
    profiles: DataFrame,
    jobs: JobSpec | list[JobSpec],
    path: str,
    *,
    k: int = C.TOP_K_FEATURES,
    tie_break: str = topk.BY_ID,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Write the best ``k`` rows per job as Parquet and return what the one job met on its way.

    ``jd_id, n_read, n_scored, n_kept``: profiles read, rows scored for the job, rows written for it; zeros for a job without
    rows, in the order of ``jobs``.  The counts are metrics observed on the scan, the scores and the cut while the ranking is written, so
    they cost no second pass and no shuffle.  Tasks that Spark runs again after losing an executor are counted again;
    ``reports.counts`` gives counts that bear this, at the price of a pass.
    """
    jobs = [jobs] if isinstance(jobs, JobSpec) else list(jobs)
    spark = profiles.sparkSession
    read, met, kept = (Observation(f"{name}-{uuid.uuid4().hex}") for name in ("read", "scored", "kept"))

    def per_job() -> list:
        return [F.count_if(F.col("jd_id") == F.lit(j.jd_id)).alias(f"n{i}") for i, j in enumerate(jobs)]

    if not jobs:
        keep_best(score_all(profiles, jobs), k, tie_break, keep).write.mode("overwrite").parquet(path)
        return spark.createDataFrame([], "jd_id string, n_read long, n_scored long, n_kept long")
    scored = score_all(profiles.observe(read, F.count(F.lit(1)).alias("n")), jobs).observe(met, *per_job())
    best = keep_best(scored, k, tie_break, keep).observe(kept, *per_job())
    best.write.mode("overwrite").parquet(path)
    n_read, n_met, n_kept = read.get["n"], met.get, kept.get
    rows = [(j.jd_id, n_read, n_met[f"n{i}"], n_kept[f"n{i}"]) for i, j in enumerate(jobs)]
    return spark.createDataFrame(rows, "jd_id string, n_read long, n_scored long, n_kept long")


def rank_table(
    df: DataFrame,
    record: list[str],
    jobs: JobSpec | list[JobSpec],
    *,
    schema_map: SchemaMap | None = None,
    signals_field: str = DEFAULT_SIGNALS_FIELD,
    **options,
) -> RankingResult:
    """Rank a typed table, such as Parquet, whose ``record`` columns form the records."""
    schema_map = schema_map or SchemaMap.from_struct(df.sparkSession, df.select(*record).schema)
    extra = tuple(c for c in ("retrieval_score", *options.get("keep", ())) if c in df.columns)
    profiles = profiles_from_columns(df, schema_map, record=record, keep=extra, signals_field=signals_field)
    return rank(profiles, jobs, schema_map, **options)


def rank_json(
    df: DataFrame,
    jobs: JobSpec | list[JobSpec],
    schema_map: SchemaMap,
    *,
    raw: str = "raw",
    row_id: str | None = None,
    row_id_in_text: bool = True,
    signals_field: str = DEFAULT_SIGNALS_FIELD,
    **options,
) -> RankingResult:
    """Rank a table of raw JSON records."""
    extra = tuple(c for c in ("retrieval_score", *options.get("keep", ())) if c in df.columns)
    profiles = profiles_from_json(
        df, schema_map, raw=raw, keep=extra, signals_field=signals_field, row_id=row_id, row_id_in_text=row_id_in_text
    )
    return rank(profiles, jobs, schema_map, **options)


def rank_files(
    spark: SparkSession,
    path: str | list[str],
    jobs: JobSpec | list[JobSpec],
    schema: dict | SchemaMap,
    *,
    mode: str = "FAILFAST",
    late_ids: bool = False,
    **options,
) -> RankingResult:
    """Rank JSONL files (plain or gzip) under a JSON Schema document or a schema map.

    ``mode`` says what malformed lines do: stop the job with their line number (``FAILFAST``)
    or stay out (``DROP``; ``readers.quarantine`` lists them).

    Line numbers stand in for missing ids and are part of the record's text.  With ``late_ids`` they are not:
    the records are scored in one scan under their place in the input, and only the ranked rows
    learn their line numbers (column ``row_id``), from counts per split.
    """
    schema_map = schema if isinstance(schema, SchemaMap) else SchemaMap.from_json_schema(spark, schema)
    records = read_jsonl(spark, path, mode=mode, late_ids=late_ids)
    if not late_ids:
        return rank_json(records, jobs, schema_map, row_id="row_id", **options)
    # a name that sorts like the line it stands for, replaced as soon as rows are few
    width = [F.lpad(F.col(c).cast("string"), 20, "0") for c in PLACE[1:]]
    records = records.withColumn("_place", F.concat(F.lit(PLACE_MARK), *width))
    keep = (*PLACE, *options.pop("keep", ()))
    k_export = options.pop("k_export", C.TOP_K_EXPORT)
    found = rank_json(records, jobs, schema_map, row_id="_place", row_id_in_text=False, keep=keep, **options)
    offsets = line_offsets(read_lines(spark, path))
    ranked = named_by_line(number_lines(found.ranked, offsets))
    return RankingResult(schema_map, found.jobs, found.scored, ranked, reports.export_rows(ranked, k_export))


def named_by_line(rows: DataFrame) -> DataFrame:
    """Line numbers in place of the stand-ins for them."""
    named = {c: F.when(F.startswith(c, F.lit(PLACE_MARK)), F.col("row_id").cast("string")).otherwise(F.col(c)) for c in ("candidate_id", "display_name")}
    return rows.withColumns({c: v for c, v in named.items() if c in rows.columns})


def raw_backfill(best: DataFrame, source: DataFrame, keys: list[str], columns: list[str], max_keys: int = MAX_CUT_IDS) -> DataFrame:
    """Fetch wide columns for a shortlist by key instead of carrying them through top-K.

    The shortlist is written to the shared folder at once, so it is computed once and its size is known.  Its
    distinct keys are counted and, up to ``max_keys`` of them, filter the source by a broadcast before any row of it
    moves; only rows that the shortlist names meet it.  With more keys Spark joins the source as it joins any table.
    Null keys have no rows; a key that repeats in the source gives one row for each.
    """
    spark = best.sparkSession
    path = f"{shared_dir(spark)}/backfill-{uuid.uuid4().hex}"
    best.write.parquet(path)
    best = spark.read.schema(best.schema).parquet(path)
    named = best.select(*keys).distinct()
    rows = source.select(*keys, *columns)
    if named.count() <= max_keys:
        rows = rows.join(F.broadcast(named), keys, "left_semi")
    return rows.join(best, keys, "inner")
