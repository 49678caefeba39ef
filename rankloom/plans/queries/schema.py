"""Queries for schema mapping and for typed values out of raw JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.functions import json_text as J
from rankloom.operators import profile as P
from rankloom.operators import schema_map as S
from rankloom.operators.replies import validate_replies
from rankloom.plans import oracle as O
from rankloom.plans.fixtures import CANDIDATE_JOBS
from rankloom.plans.queries.registry import candidates_json, joined, query, schema_map, table
from rankloom.plans.ranking import score_all
from rankloom.sources.readers import valid_schema_documents

# the shape of the derived candidate records, for the SQL side
_PATHS = (
    "$.candidate_id $.profile $.profile.anonymized_name $.profile.country $.profile.current_title $.profile.location "
    "$.profile.years_of_experience $.summary $.skills $.skills[] $.skills[].name $.skills[].proficiency "
    "$.skills[].duration_months $.skills[].endorsements $.career_history $.career_history[] $.career_history[].title "
    "$.career_history[].duration_months $.career_history[].is_current $.education $.education[] $.education[].degree "
    "$.education[].tier $.signals $.signals.recruiter_response_rate $.signals.avg_response_time_hours "
    "$.signals.profile_completeness_score $.signals.profile_views_received_30d $.signals.saved_by_recruiters_30d "
    "$.signals.interview_completion_rate $.signals.offer_acceptance_rate $.signals.github_activity_score "
    "$.signals.verified_email $.signals.verified_phone $.signals.linkedin_connected $.signals.open_to_work_flag "
    "$.signals.willing_to_relocate $.signals.notice_period_days"
).split()

_PATH_CTE = (
    f"p AS (SELECT unnest({O._list(_PATHS)}) AS path), k(field, word) AS (VALUES "
    + ", ".join(f"('{f}', '{w}')" for f, ws in C.SEMANTIC_KEYWORDS.items() for w in ws)
    + """), h AS (SELECT field, path, count(*) AS score FROM p JOIN k ON contains(lower(path), word) GROUP BY field, path),
r AS (SELECT field, path, score, row_number() OVER (PARTITION BY field ORDER BY score DESC, length(path), path) AS rank FROM h)"""
)


def _parsed(spark, sf):
    return P.parse_records(candidates_json(spark, sf))


def _paths(spark, sf):
    return S.paths_frame(spark, S.paths_of_variants(_parsed(spark, sf), "v"))


@query("schema_paths", f"SELECT unnest({O._list(_PATHS)}) AS path")
def _(spark, sf):
    return _paths(spark, sf)


@query("rank_paths", f"WITH {_PATH_CTE} SELECT field, CAST(rank AS INTEGER) AS rank, path, score FROM r WHERE rank <= 8")
def _(spark, sf):
    return S.rank_paths(_paths(spark, sf))


@query(
    "schema_map",
    f"""WITH {_PATH_CTE} SELECT f.field, coalesce(string_agg(path, '|' ORDER BY rank), '') AS paths, round(least(1.0, count(path) / 3.0), 6) AS confidence
FROM (SELECT DISTINCT field FROM k) f LEFT JOIN (SELECT * FROM r WHERE rank <= 8) r ON r.field = f.field GROUP BY f.field""",
)
def _(spark, sf):
    rows = S.schema_map_frame(_paths(spark, sf))
    return rows.select("field", joined("paths").alias("paths"), F.round("confidence", 6).alias("confidence"))


@query(
    "field_confidence",
    f"WITH {_PATH_CTE} SELECT field, count(*) AS n_paths, round(least(1.0, count(*) / 3.0), 6) AS confidence FROM r WHERE rank <= 8 GROUP BY field",
)
def _(spark, sf):
    rows = S.schema_map_frame(_paths(spark, sf)).where(F.size("paths") > 0)
    return rows.select("field", F.size("paths").cast("long").alias("n_paths"), F.round("confidence", 6).alias("confidence"))


@query(
    "resolve_paths",
    O.on_candidates(
        """SELECT key, array_to_string(list_filter([country, location], lambda x: x IS NOT NULL AND x <> ''), ' ') AS location_text,
  array_to_string(list_concat([title], list_transform(history, lambda h: h.title)), ' ') AS seniority_text, 1 + len(history) AS n_seniority,
  len(list_filter(history, lambda h: h.is_current)) >= 0 AS ok FROM cand""",
        "cand",
    ),
)
def _(spark, sf):
    m = schema_map(spark, sf)
    rows = _parsed(spark, sf)
    v = F.col("v")
    seniority = J.resolve_paths(v, m["seniority"])
    return rows.select(
        "key",
        J.resolved_text(J.resolve_paths(v, m["location"])).alias("location_text"),
        J.resolved_text(seniority).alias("seniority_text"),
        F.size(seniority).alias("n_seniority"),
        (F.size(J.resolve_paths(v, m["experience"])) >= 0).alias("ok"),
    )


@query("display_name", O.on_candidates("SELECT key, name AS display_name FROM cand", "cand"))
def _(spark, sf):
    name = P.display_name_of(F.col("v"), schema_map(spark, sf), F.col("key"))
    return _parsed(spark, sf).select("key", name.alias("display_name"))


@query("candidate_id", O.on_candidates("SELECT key, candidate_id FROM cand", "cand"))
def _(spark, sf):
    cid = P.candidate_id_of(F.col("v"), schema_map(spark, sf), F.col("key"), F.lit("Unknown Candidate"))
    return _parsed(spark, sf).select("key", cid.alias("candidate_id"))


@query(
    "path_text_number",
    O.on_candidates(
        "SELECT key, title, profile_years AS years, coalesce(CAST(profile_years AS VARCHAR), '') AS years_text, '' AS absent FROM cand", "cand"
    ),
)
def _(spark, sf):
    v = F.col("v")
    at = lambda path: F.try_variant_get(v, path, "variant")
    text = lambda path: F.coalesce(J.json_text(F.to_json(at(path))), F.lit(""))
    years = J.variant_number(at("$.profile.years_of_experience"))
    return _parsed(spark, sf).select(
        "key",
        text("$.profile.current_title").alias("title"),
        years.alias("years"),
        F.coalesce(years.cast("string"), F.lit("")).alias("years_text"),
        text("$.profile.current_title.deeper").alias("absent"),
    )


@query(
    "skill_records",
    O.on_candidates(
        "SELECT key, len(skills) AS n_skills, array_to_string(list_transform(skills, lambda s: s.name || ':' || s.proficiency), '|') AS skills FROM cand",
        "cand",
    ),
)
def _(spark, sf):
    items = F.transform(F.try_variant_get("v", "$.skills", "array<variant>"), P.variant_skill)
    rows = _parsed(spark, sf).select("key", P.named_skills(items).alias("s"))
    label = F.transform("s", lambda s: F.concat(s["name"], F.lit(":"), s["proficiency"]))
    return rows.select("key", F.size("s").alias("n_skills"), joined(label).alias("skills"))


@query(
    "json_records_scored",
    O.on_candidates("SELECT jd_id, candidate_id, composite_score FROM scored", "scored"),
)
def _(spark, sf):
    """The whole scoring plan from raw JSON text."""
    profiles = P.profiles_from_json(candidates_json(spark, sf), schema_map(spark, sf))
    return score_all(profiles, CANDIDATE_JOBS).select("jd_id", "candidate_id", "composite_score")


@query(
    "validate_schema_doc",
    """SELECT 'events' AS source, count(*) AS n, count(*) AS n_valid FROM events UNION ALL SELECT 'conversations', count(*), 0 FROM conversations
UNION ALL SELECT 'typed', count(*), count(*) FILTER (WHERE p_partkey % 2 = 0) FROM part""",
)
def _(spark, sf):
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("object")).otherwise(F.col("p_type"))
    docs = (
        table(spark, sf, "events").select(F.lit("events").alias("source"), F.col("props").alias("raw"))
        .unionAll(table(spark, sf, "conversations").select(F.lit("conversations"), "text"))
        .unionAll(table(spark, sf, "part").select(F.lit("typed"), F.to_json(F.struct(kind.alias("type"), "p_name"))))
    )
    return valid_schema_documents(docs).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid")
    )


@query(
    "validate_json_response",
    """SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_shape' WHEN 4 THEN 'invalid_shape' ELSE 'ok' END AS status,
  CASE WHEN event_id % 5 IN (0, 1) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def _(spark, sf):
    m = F.col("event_id") % 5
    content = (
        F.when(m == 0, F.col("props"))
        .when(m == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("not-json "), F.col("props")))
        .when(m == 3, F.lit('{"other": 1}'))
        .otherwise(F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('"}')))
    )
    rows = table(spark, sf, "events").select("event_id", content.alias("content"))
    return validate_replies(rows, "content", "k bigint", ["k"]).select("event_id", "status", F.col("parsed.k").alias("k"))
