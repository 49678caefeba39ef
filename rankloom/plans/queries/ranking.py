"""Queries for top-K, ranks, reasons, exports and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.functions.numeric import once
from rankloom.operators import reasons, reports, topk
from rankloom.plans import oracle as O
from rankloom.plans.fixtures import CANDIDATE_JOBS
from rankloom.plans.queries.registry import (
    as_json,
    as_profiles,
    candidates,
    detailed,
    documents_scored,
    joined,
    profiles,
    query,
    ranked,
    scratch,
    scored,
    scored_star,
    table,
    written,
)
from rankloom.plans.ranking import keep_best, rank, raw_backfill, score_all, write_ranking

_TOP = "(SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY composite_score DESC, candidate_id) AS place FROM {0}) WHERE place <= {1}"


def _star(df):
    return df.where("jd_id = 'star'")


@query(
    "rank_candidates",
    O.on_candidates(
        "SELECT candidate_id, composite_score FROM scored WHERE jd_id = 'star' ORDER BY composite_score DESC, candidate_id LIMIT 500",
        "scored",
    ),
)
def _(spark, sf):
    rows = scored_star(spark, sf).select("candidate_id", "composite_score")
    return topk.top_k(rows, 500, topk.score_order())


# scores rounded to whole numbers, so that the cut falls inside a group of equals
_TIED = "SELECT candidate_id, round(composite_score) AS score FROM scored WHERE jd_id = 'star'"


@query(
    "rank_candidates_heap",
    O.on_candidates(f"SELECT * FROM ({_TIED}) ORDER BY score DESC, candidate_id DESC LIMIT 100", "scored"),
)
def _(spark, sf):
    rows = scored_star(spark, sf).select("candidate_id", F.round("composite_score").alias("score"))
    return topk.top_k(rows, 100, topk.score_order("score", tie_break=topk.BY_HEAP))


@query(
    "topk_per_jd",
    O.on_candidates(f"SELECT jd_id, candidate_id, composite_score FROM {_TOP.format('scored', 50)}", "scored"),
)
def _(spark, sf):
    rows = scored(spark, sf).select("jd_id", "candidate_id", "composite_score")
    return topk.top_k(rows, 50, topk.score_order(), ["jd_id"])


@query(
    "rank_rows",
    O.on_candidates("SELECT jd_id, candidate_id, rank FROM rs"),
)
def _(spark, sf):
    """Every scored row has a rank, not a shortlist only."""
    rows = detailed(spark, sf).select("jd_id", "candidate_id", "composite_score")
    rows = written(spark, rows, "scores")  # read twice
    return topk.rank_rows(rows, ["jd_id"], topk.score_order(), scratch(spark, "ranks")).select("jd_id", "candidate_id", "rank")


_NORM = f"""SELECT jd_id, candidate_id, place AS rank, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE 0.1 + 0.9 * ((composite_score - lo) / (hi - lo)) END AS norm_score
FROM (SELECT *, min(composite_score) OVER (PARTITION BY jd_id) AS lo, max(composite_score) OVER (PARTITION BY jd_id) AS hi FROM {_TOP.format('{0}', 100)})"""


@query(
    "minmax_norm",
    O.on_candidates(f"SELECT jd_id, candidate_id, printf('%.8f', norm_score) AS score FROM ({_NORM.format('scored')})", "scored"),
)
def _(spark, sf):
    short = reports.shortlist(ranked(spark, sf))
    return short.select("jd_id", "candidate_id", topk.format_score(F.col("norm_score")).alias("score"))


@query(
    "minmax_of_export",
    O.on_candidates(
        f"SELECT jd_id, min(composite_score) AS low, max(composite_score) AS high, count(*) AS n FROM {_TOP.format('scored', 100)} GROUP BY jd_id",
        "scored",
    ),
)
def _(spark, sf):
    return reports.shortlist(ranked(spark, sf)).groupBy("jd_id").agg(
        F.min("composite_score").alias("low"), F.max("composite_score").alias("high"), F.count("*").alias("n")
    )


@query(
    "export_projection",
    O.on_candidates(
        f"SELECT n.jd_id, n.candidate_id, n.rank, printf('%.8f', n.norm_score) AS score, rs.evidence_reason AS reasoning FROM ({_NORM.format('rs')}) n JOIN rs ON rs.jd_id = n.jd_id AND rs.candidate_id = n.candidate_id"
    ),
)
def _(spark, sf):
    return reports.export_rows(ranked(spark, sf))


@query(
    "document_ranking",
    O.on_documents(
        f"SELECT n.jd_id, n.candidate_id, n.rank, printf('%.8f', n.norm_score) AS score, rs.fallback_reason AS reasoning FROM ({_NORM.format('rs')}) n JOIN rs ON rs.jd_id = n.jd_id AND rs.candidate_id = n.candidate_id"
    ),
)
def _(spark, sf):
    return reports.export_rows(keep_best(documents_scored(spark, sf), C.TOP_K_FEATURES))


@query(
    "detail_projection",
    O.on_candidates(
        """SELECT jd_id, candidate_id, display_name, b_technical_fit AS technical_fit, b_evidence_confidence AS evidence_confidence,
  array_to_string(matched, '|') AS matched_skills, array_to_string(missing, '|') AS missing_skills, array_to_string(strengths, '|') AS strengths,
  array_to_string(concerns, '|') AS concerns, array_to_string(integrity_flags, '|') AS integrity_flags, composite_score AS score FROM rs WHERE rank <= 500"""
    ),
)
def _(spark, sf):
    rows = reports.detail_rows(ranked(spark, sf))
    lists = ["matched_skills", "missing_skills", "strengths", "concerns", "integrity_flags"]
    return rows.select(
        "jd_id",
        "candidate_id",
        "display_name",
        F.col("breakdown.technical_fit"),
        F.col("breakdown.evidence_confidence"),
        *[joined(c).alias(c) for c in lists],
        "score",
    )


@query(
    "candidate_lookup",
    O.on_candidates("SELECT jd_id, candidate_id, composite_score FROM rs WHERE rank <= 500 AND candidate_id = (SELECT max(candidate_id) FROM rs WHERE jd_id = 'star' AND rank <= 500)"),
)
def _(spark, sf):
    rows = written(spark, ranked(spark, sf), "shortlist")  # read twice
    last = _star(rows).agg(F.max("candidate_id")).scalar()
    return reports.candidate_lookup(rows, last).select("jd_id", "candidate_id", "composite_score")


@query(
    "feature_means_top20",
    O.on_candidates(
        "SELECT jd_id, f.name AS feature, round(f.value, 4) AS average_score FROM (SELECT jd_id, unnest(["
        + ", ".join(f"{{'name': '{n}', 'value': avg(b_{n})}}" for n in C.BREAKDOWN)
        + "]) AS f FROM rs WHERE rank <= 20 GROUP BY jd_id)"
    ),
)
def _(spark, sf):
    return reports.feature_means(ranked(spark, sf)).withColumn("average_score", F.round("average_score", 4))


@query(
    "score_histogram",
    O.on_candidates(
        """SELECT jd_id, bin, count(*) AS n FROM (SELECT jd_id, CAST(least(floor((composite_score - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin
FROM (SELECT *, min(composite_score) OVER (PARTITION BY jd_id) AS lo, max(composite_score) OVER (PARTITION BY jd_id) AS hi FROM scored)) GROUP BY jd_id, bin""",
        "scored",
    ),
)
def _(spark, sf):
    return reports.histogram(scored(spark, sf).select("jd_id", "composite_score"), "composite_score")


@query(
    "counts_reported",
    O.on_candidates("SELECT jd_id, count(*) AS n_scored, least(count(*), 500) AS n_kept FROM scored GROUP BY jd_id", "scored"),
)
def _(spark, sf):
    return reports.counts(scored(spark, sf), 500)


@query(
    "counts_observed",
    O.on_candidates("SELECT jd_id, count(*) AS n_read, count(*) AS n_scored, least(count(*), 500) AS n_kept FROM scored GROUP BY jd_id", "scored"),
)
def _(spark, sf):
    """Counts met while the ranking is written, without a pass of their own."""
    return write_ranking(profiles(spark, sf), CANDIDATE_JOBS, scratch(spark, "ranking"))


def _funnel_sql(first: int, second: int, last: int) -> str:
    return O.on_candidates(
        f""", cut1 AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY round(lexical_relevance, 12) DESC, candidate_id) AS p1 FROM scored),
cut2 AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY composite_score DESC, candidate_id) AS p2 FROM cut1 WHERE p1 <= {first})
SELECT jd_id, candidate_id, composite_score FROM cut2 WHERE p2 <= {min(second, last)}""",
        "scored",
    )


def _funnel(spark, sf, first: int, second: int, last: int):
    from rankloom.functions import text as X
    from rankloom.jobs import job_literal
    # the cheap score of the first cut needs the tokens and nothing else; every job has its own
    def cheap(tokens):
        scores = [(F.lit(j.jd_id), 2 * F.round(X.keyword_density(tokens, job_literal(j)["lexical"]), 12) - 1) for j in CANDIDATE_JOBS]
        return F.create_map(*[c for pair in scores for c in pair])

    people = written(spark, candidates(spark, sf), "candidates")  # read by the cut and by the scores
    rows = as_profiles(spark, sf, people).withColumn("retrieval_score", once(X.tokens(F.col("text")), cheap))
    result = rank(rows, CANDIDATE_JOBS, k_retrieval=first, k_features=second, k_export=last)
    best = topk.top_k(result.ranked, last, topk.score_order(), ["jd_id"])
    return best.select("jd_id", "candidate_id", "composite_score")


@query("funnel", _funnel_sql(5000, 500, 100))
def _(spark, sf):
    return _funnel(spark, sf, C.TOP_K_RETRIEVAL, C.TOP_K_FEATURES, C.TOP_K_EXPORT)


@query("funnel_narrow", _funnel_sql(300, 120, 50))
def _(spark, sf):
    """The same with cuts that bite on small tables too."""
    return _funnel(spark, sf, 300, 120, 50)


@query(
    "raw_backfill",
    O.on_candidates("SELECT jd_id, candidate_id, composite_score, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY composite_score DESC, candidate_id) AS place FROM scored) WHERE place <= 100", "scored"),
)
def _(spark, sf):
    from rankloom.functions.json_text import json_text

    people = written(spark, candidates(spark, sf), "candidates")  # read by the scores and by the backfill
    keys = score_all(as_profiles(spark, sf, people), CANDIDATE_JOBS).select("jd_id", "key", "candidate_id", "composite_score")
    best = topk.top_k(keys, 100, topk.score_order(), ["jd_id"])
    rows = raw_backfill(best, as_json(people), ["key"], ["raw"])
    return rows.select("jd_id", "candidate_id", "composite_score", F.length(json_text(F.col("raw"))).alias("n_chars"))


@query(
    "explanation_lookup",
    O.on_candidates(
        """, ex AS (SELECT 'CAND_' || lpad(CAST(conv_id AS VARCHAR), 7, '0') AS candidate_id, arg_max(text, turn) AS summary FROM conversations GROUP BY conv_id)
SELECT jd_id, rs.candidate_id, md5(ex.summary) AS summary FROM rs LEFT JOIN ex USING (candidate_id) WHERE rank <= 500"""
    ),
)
def _(spark, sf):
    notes = table(spark, sf, "conversations").select(
        F.concat(F.lit("CAND_"), F.lpad(F.col("conv_id").cast("string"), 7, "0")).alias("candidate_id"),
        F.col("text").alias("summary"),
        F.col("turn").alias("position"),
    )
    rows = reports.explanation_lookup(ranked(spark, sf), notes, "position")
    return rows.select("jd_id", "candidate_id", F.md5("explanation.summary").alias("summary"))


# the same fields in the same order; both writers print doubles of two digits alike
_PAYLOAD = (
    "{'candidate_id': candidate_id, 'display_name': display_name, 'composite_score': composite_score, 'breakdown': {"
    + ", ".join(f"'{n}': b_{n}" for n in C.BREAKDOWN)
    + "}, 'matched_skills': matched, 'missing_skills': missing, 'strengths': strengths, 'concerns': concerns, "
    "'integrity_flags': integrity_flags, 'scoring_reasoning': evidence_reason}"
)


@query(
    "explanation_payload",
    O.on_candidates(f"SELECT jd_id, candidate_id, CAST(to_json({_PAYLOAD}) AS VARCHAR) AS payload FROM rs WHERE rank <= {C.TOP_K_EXPORT}"),
)
def _(spark, sf):
    best = topk.top_k(ranked(spark, sf), C.TOP_K_EXPORT, topk.score_order(), ["jd_id"])
    return reports.explanation_payload(reasons.add_reasoning(best))


_JOB_RECORDS = ", ".join(
    "('{}', '{}')".format(j.jd_id, json.dumps(j.as_dict(), ensure_ascii=False, separators=(",", ":")).replace("'", "''"))
    for j in CANDIDATE_JOBS
)


@query(
    "explanation_requests",
    O.on_candidates(
        f""", j(jd_id, job) AS (VALUES {_JOB_RECORDS}),
best AS (SELECT jd_id, count(*) AS n, string_agg(CAST(to_json({_PAYLOAD}) AS VARCHAR), ',' ORDER BY rank) AS rows FROM rs WHERE rank <= {C.TOP_K_EXPORT} GROUP BY jd_id)
SELECT j.jd_id, coalesce(n, 0) AS n_candidates, '{{"jd_intelligence":' || job || ',"ranked_candidates":[' || coalesce(rows, '') || ']}}' AS request FROM j LEFT JOIN best ON best.jd_id = j.jd_id"""
    ),
)
def _(spark, sf):
    return reports.explanation_requests(ranked(spark, sf), CANDIDATE_JOBS)


# ---------------------------------------------------------------------------
# reasons
# ---------------------------------------------------------------------------

_NAMES = "array_to_string(list_transform({0}, lambda nm: nm.name), '|')"


def _names(col):
    return joined(F.transform(col, lambda s: s["name"]))


@query(
    "matched_skill_records",
    O.on_candidates(f"SELECT jd_id, candidate_id, {_NAMES.format('hit_sorted')} AS skills FROM rs"),
)
def _(spark, sf):
    rows = detailed(spark, sf)
    found = reasons.matched_skill_records(F.col("listed_skills"), F.col("matched_skills"))
    return rows.select("jd_id", "candidate_id", _names(found).alias("skills"))


@query(
    "sort_skills",
    O.on_candidates(f"SELECT candidate_id, {_NAMES.format(O._sorted('skills'))} AS skills FROM prof", "prof"),
)
def _(spark, sf):
    return profiles(spark, sf).select("candidate_id", _names(reasons.sort_skills(F.col("skills"))).alias("skills"))


@query("skill_phrase", O.on_candidates("SELECT jd_id, candidate_id, skill_phrase FROM rs"))
def _(spark, sf):
    listed = F.col("listed_skills")
    matched = reasons.matched_skill_records(listed, F.col("matched_skills"))
    phrase = reasons.skill_phrase(F.col("m"), listed)
    rows = detailed(spark, sf).select("jd_id", "candidate_id", "listed_skills", matched.alias("m"))
    return rows.select("jd_id", "candidate_id", phrase.alias("skill_phrase"))


@query("signal_phrase", O.on_candidates("SELECT DISTINCT candidate_id, signal_phrase FROM rs"))
def _(spark, sf):
    return profiles(spark, sf).select("candidate_id", reasons.signal_phrase(F.col("signals")).alias("signal_phrase"))


@query(
    "assessment_phrase",
    """WITH a AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY user_id, event_type)
SELECT user_id, count(*) || ' skill assessments averaging ' || printf('%.0f', avg(v)) || '/100' AS phrase FROM a GROUP BY user_id""",
)
def _(spark, sf):
    kinds = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    rows = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list("v")).alias("scores"))
    return rows.select("user_id", reasons.assessment_phrase(F.col("scores")).alias("phrase"))


@query("gap_phrase", O.on_candidates("SELECT jd_id, candidate_id, gap_phrase FROM rs"))
def _(spark, sf):
    return detailed(spark, sf).select(
        "jd_id", "candidate_id", reasons.gap_phrase(F.col("missing_skills")).alias("gap_phrase")
    )


@query("evidence_reason", O.on_candidates("SELECT jd_id, candidate_id, evidence_reason FROM rs"))
def _(spark, sf):
    rows = detailed(spark, sf)
    return rows.select("jd_id", "candidate_id", reasons.evidence_reason(F.col).alias("evidence_reason"))


@query("fallback_reason", O.on_candidates("SELECT jd_id, candidate_id, fallback_reason FROM rs"))
def _(spark, sf):
    rows = detailed(spark, sf)
    return rows.select("jd_id", "candidate_id", reasons.fallback_reason(F.col).alias("fallback_reason"))


@query("scoring_reasoning", O.on_candidates("SELECT jd_id, candidate_id, evidence_reason AS reasoning FROM rs WHERE rank <= 500"))
def _(spark, sf):
    return reasons.add_reasoning(ranked(spark, sf)).select("jd_id", "candidate_id", "reasoning")


@query(
    "list_prefixes",
    O.on_candidates(
        """SELECT candidate_id, len(list_slice(skills, 1, 6)) AS n_six, array_to_string(list_transform(list_slice(skills, 1, 3), lambda x: x.name), '|') AS first_three,
  len(list_slice(history, 1, 4)) AS n_jobs FROM cand""",
        "cand",
    ),
)
def _(spark, sf):
    return candidates(spark, sf).select(
        "candidate_id",
        F.size(F.slice("skills", 1, 6)).alias("n_six"),
        _names(F.slice("skills", 1, 3)).alias("first_three"),
        F.size(F.slice("career_history", 1, 4)).alias("n_jobs"),
    )
