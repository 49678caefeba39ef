"""Queries for the feature operators, over all candidates and all fixture jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.operators.features import skill_evidence
from rankloom.operators.reports import breakdown_long
from rankloom.plans import oracle as O
from rankloom.plans.queries.registry import detailed, joined, profiles, query, r6, scored, with_tokens

SINGLE = {
    "required_coverage": "required_coverage",
    "preferred_coverage": "preferred_coverage",
    "skill_overlap_score": "skill_overlap_score",
    "skill_depth": "skill_depth",
    "role_fit": "role_fit",
    "experience_score": "experience_score",
    "seniority_score": "seniority_score",
    "career_consistency": "career_score",
    "behavioral_score": "behavioral_score",
    "availability_score": "availability_score",
    "education_score": "education_score",
    "location_score": "location_score",
    "evidence_confidence": "evidence_confidence",
    "technical_fit": "technical_fit",
    "role_relevance": "role_relevance",
    "hireability": "hireability",
    "must_have_gate": "must_have_gate",
    "lexical_relevance_all_jobs": "lexical_relevance",
    "production_score_all_jobs": "production_score",
}


def _single(name: str, column: str) -> None:
    sql = O.on_candidates(f"SELECT jd_id, candidate_id, round({column}, 6) AS {column} FROM scored", "scored")

    @query(name, sql)
    def _(spark, sf):
        return scored(spark, sf).select("jd_id", "candidate_id", r6(column).alias(column))


for _name, _column in SINGLE.items():
    _single(_name, _column)


@query(
    "composite_score",
    O.on_candidates("SELECT jd_id, candidate_id, composite_score FROM scored", "scored"),
)
def _(spark, sf):
    return scored(spark, sf).select("jd_id", "candidate_id", "composite_score")


@query(
    "candidate_years",
    O.on_candidates("SELECT candidate_id, round(years, 6) AS years FROM prof", "prof"),
)
def _(spark, sf):
    return with_tokens(spark, sf).select("candidate_id", r6("years").alias("years"))


@query(
    "skill_evidence",
    O.on_candidates(
        f"SELECT candidate_id, sv.name AS skill, round({O._EVIDENCE}, 6) AS evidence FROM (SELECT candidate_id, unnest(skills) AS sv FROM prof)",
        "prof",
    ),
)
def _(spark, sf):
    rows = profiles(spark, sf).select("candidate_id", F.explode("skills").alias("s"))
    return rows.select("candidate_id", F.col("s.name").alias("skill"), r6(skill_evidence(F.col("s"))).alias("evidence"))


@query(
    "term_match",
    O.on_candidates(
        """SELECT jd_id, candidate_id, z[1].term AS term, round(z[2], 6) AS score
FROM (SELECT jd_id, candidate_id, unnest(list_zip(list_concat(required, preferred), all_scores)) AS z FROM scored)""",
        "scored",
    ),
)
def _(spark, sf):
    pairs = F.arrays_zip(
        F.concat(F.col("jd.required"), F.col("jd.preferred")).alias("t"),
        F.concat("required_scores", "preferred_scores").alias("s"),
    )
    rows = scored(spark, sf).select("jd_id", "candidate_id", F.explode(pairs).alias("p"))
    return rows.select("jd_id", "candidate_id", F.col("p.t.term").alias("term"), r6("p.s").alias("score"))


@query(
    "matched_missing",
    O.on_candidates(
        """SELECT jd_id, candidate_id, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing,
  array_to_string(missing_required, '|') AS missing_required FROM det""",
        "det",
    ),
)
def _(spark, sf):
    return detailed(spark, sf).select(
        "jd_id",
        "candidate_id",
        joined("matched_skills").alias("matched"),
        joined("missing_skills").alias("missing"),
        joined("missing_required").alias("missing_required"),
    )


@query(
    "breakdown",
    O.on_candidates(
        "SELECT jd_id, candidate_id, f.name AS feature, f.value AS value FROM (SELECT jd_id, candidate_id, unnest(["
        + ", ".join(f"{{'name': '{n}', 'value': b_{n}}}" for n in C.BREAKDOWN)
        + "]) AS f FROM det)",
        "det",
    ),
)
def _(spark, sf):
    return breakdown_long(detailed(spark, sf), "jd_id", "candidate_id")


@query(
    "strengths",
    O.on_candidates("SELECT jd_id, candidate_id, array_to_string(strengths, '|') AS strengths FROM det", "det"),
)
def _(spark, sf):
    return detailed(spark, sf).select("jd_id", "candidate_id", joined("strengths").alias("strengths"))


@query(
    "concerns",
    O.on_candidates("SELECT jd_id, candidate_id, array_to_string(concerns, '|') AS concerns FROM det", "det"),
)
def _(spark, sf):
    return detailed(spark, sf).select("jd_id", "candidate_id", joined("concerns").alias("concerns"))


@query(
    "ordered_list_union",
    O.on_candidates(
        """SELECT note, count(*) AS n FROM (SELECT unnest(integrity_flags) AS note FROM det UNION ALL SELECT unnest(concerns) FROM det) GROUP BY note""",
        "det",
    ),
)
def _(spark, sf):
    rows = detailed(spark, sf).select(F.explode(F.concat("integrity_flags", "concerns")).alias("note"))
    return rows.groupBy("note").agg(F.count("*").alias("n"))


@query(
    "cross_jd",
    O.on_candidates(
        "SELECT jd_id, count(*) AS n_rows, round(avg(composite_score), 4) AS mean_score, max(composite_score) AS best FROM scored GROUP BY jd_id",
        "scored",
    ),
)
def _(spark, sf):
    return scored(spark, sf).groupBy("jd_id").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("composite_score"), 4).alias("mean_score"),
        F.max("composite_score").alias("best"),
    )
