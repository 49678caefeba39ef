"""Explainable features of a profile against a job, in four plan layers.

1. ``add_tokens``    - what depends on the record alone: token set, skill evidence
   (and ``add_record_features``, its features that no job changes).
2. ``with_jobs``     - attach the job (literal or exploded literals, see ``jobs``).
3. ``add_features``  - one column per feature.
4. ``add_scores``    - weighted groups and the composite score.

Each layer is one projection, so an expensive value is computed once and reused.
The record's tokens meet the job's whole vocabulary once (``hits``); every term is
then compared with that small intersection, never with the full token set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import constants as C
from rankloom.functions import text as X
from rankloom.functions.numeric import (
    array_mean,
    clamp,
    mean_of_best,
    mean_score,
    non_zero_or,
    once,
    semantic_rescale,
    soft_cap,
)
from rankloom.jobs import JobSpec, compiled, with_jobs


def _lookup(key: Column, table: dict, default: float) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def skill_evidence(skill: Column) -> Column:
    """How well one skill record is backed by level, months and endorsements."""
    level = _lookup(F.lower(F.coalesce(skill["proficiency"], F.lit(""))), C.PROFICIENCY_SCORES, C.PROFICIENCY_DEFAULT)
    months = soft_cap(F.coalesce(skill["duration_months"], F.lit(0.0)), 48.0)
    endorsed = soft_cap(F.coalesce(skill["endorsements"], F.lit(0.0)), 40.0)
    return clamp(0.62 * level + 0.26 * months + 0.12 * endorsed)


def term_match(term: Column, lowered: Column, hits: Column, skills: Column) -> Column:
    """Best of the text evidence and the skill-record evidence for one term.

    ``skills`` holds the records' focus tokens and evidence; text evidence is token
    coverage plus a bonus for the literal phrase, skill evidence is the F1 overlap of
    the token sets weighted by the record's evidence.
    """
    focus = term["focus"]
    bonus = F.when(F.contains(lowered, term["lowered"]), F.lit(0.16)).otherwise(F.lit(0.0))
    from_text = F.least(F.lit(1.0), F.pow(X.coverage(focus, hits), F.lit(1.35)) + bonus)

    def found(skill: Column) -> Column:
        # F1 of two token sets is twice the shared tokens over the sum of both sizes
        shared = X.shared_tokens(focus, skill["focus"])
        f1 = 2.0 * shared / (F.size(focus) + F.size(skill["focus"]))
        return F.least(F.lit(1.0), f1 * (0.78 + 0.22 * skill["evidence"]))

    from_skills = F.coalesce(F.array_max(F.transform(skills, found)), F.lit(0.0))
    return F.when(F.size(focus) > 0, clamp(F.greatest(from_text, from_skills))).otherwise(F.lit(0.0))


def near_skills(skills: Column, evidence: Column, wanted: Column) -> Column:
    """Focus tokens and evidence of the skills that can share a token with the job.

    A shared token is also a substring of the name, so names without any wanted word
    as a substring are dropped before they are tokenised.
    """

    def within(context: Column) -> Column:
        names = F.zip_with(
            skills,
            context["evidence"],
            lambda s, e: F.struct(F.lower(F.coalesce(s["name"], F.lit(""))).alias("name"), e.alias("evidence")),
        )
        close = F.filter(names, lambda n: F.exists(context["wanted"], lambda w: F.contains(n["name"], w)))
        return F.transform(
            close,
            lambda n: F.struct(
                X.signal_tokens(X.tokens(n["name"]), drop_generic=True).alias("focus"), n["evidence"]
            ),
        )

    return once(F.struct(evidence.alias("evidence"), wanted.alias("wanted")), within)


def skill_depth_of_records(evidence: Column) -> Column:
    """Depth of a non-empty list of evidence values."""
    return clamp(0.58 * mean_of_best(evidence, 6) + 0.42 * soft_cap(F.size(evidence), 14.0))


# ---------------------------------------------------------------------------
# layer 1: the record alone
# ---------------------------------------------------------------------------


def add_tokens(df: DataFrame) -> DataFrame:
    """Token set, lower-cased text and the evidence behind each skill."""
    return df.select(
        "*",
        X.tokens(F.col("text")).alias("tokens"),
        F.lower("text").alias("lowered"),
        F.transform("skills", skill_evidence).alias("evidence"),
        X.tokens(F.col("location_text")).alias("location_tokens"),
        F.trim("location_text").alias("_location"),
        X.tokens(F.col("education_text")).alias("education_tokens"),
        X.join_titles(F.col("title"), F.col("headline")).alias("titles"),
    )


def add_role_tokens(df: DataFrame) -> DataFrame:
    """Tokens of the titles and role paths; the full text where there are none."""
    role = F.array_join(
        F.filter(F.array("title", "headline", "role_text"), lambda p: p != ""), " "
    )
    return df.select(
        "*",
        F.when(F.trim(role) != "", X.tokens(role)).otherwise(F.col("tokens")).alias("role_tokens"),
        F.size("tokens").alias("n_tokens"),
        F.size("skills").alias("n_skills"),
    )


def add_record_features(df: DataFrame) -> DataFrame:
    """What no job changes, once a record: below the jobs, so that it is not computed again for each."""
    c = {name: F.col(name) for name in df.columns}
    flags = integrity_flags(
        c["text"], c["lowered"], c["n_tokens"], c["signals"]["completeness"], c["experience_text"]
    )
    return df.select(
        "*",
        X.metric_mentions(c["lowered"]).alias("n_metrics"),
        career_consistency(c["history"], c["title"], c["n_tokens"]).alias("career_score"),
        behavioral_score(c["signals"]).alias("behavioral_score"),
        availability_score(c["signals"], c["availability_found"]).alias("availability_score"),
        flags.alias("integrity_flags"),
        evidence_confidence(c).alias("evidence_confidence"),
    )


def add_close_skills(df: DataFrame, jobs: list[JobSpec]) -> DataFrame:
    """Skills that can share a token with any of the jobs, tokenised once a record and not once a job."""
    wanted = list(dict.fromkeys(w for job in jobs for w in compiled(job)["skill_words"]))
    return df.withColumn("close_skills", near_skills(F.col("skills"), F.col("evidence"), X.words(wanted)))


# ---------------------------------------------------------------------------
# layer 3: one column per feature
# ---------------------------------------------------------------------------


def experience_score(years: Column, minimum: Column) -> Column:
    surplus = clamp(0.74 + 0.26 * soft_cap(years - minimum, 6.0))
    short = clamp(0.74 * F.pow(years / minimum, F.lit(1.45)))
    return (
        F.when(years <= 0, F.lit(0.45))
        .when(F.coalesce(minimum, F.lit(0.0)) <= 0, clamp(0.30 + 0.70 * soft_cap(years, 8.0)))
        .when(years >= minimum, surplus)
        .otherwise(short)
    )


def seniority_score(jd: Column, years: Column, titles: Column) -> Column:
    """``years`` counts as 0 when it is not positive."""
    y = F.greatest(years, F.lit(0.0))
    low = F.lower(titles)
    signal = F.when(X.mentions_any(low, C.SENIOR_WORDS), F.lit(1.0)).otherwise(F.lit(0.0))
    over = F.least(F.lit(0.55), F.greatest(F.lit(0.0), y - 4.0) / 12.0)
    return (
        F.when(jd["level"] == "none", clamp(0.35 + 0.65 * soft_cap(y, 8.0)))
        .when(jd["level"] == "senior", clamp(0.28 * signal + 0.72 * soft_cap(y, 7.0)))
        .when(jd["level"] == "junior", clamp(1.0 - over))
        .otherwise(X.keyword_density(X.tokens(low), jd["seniority"]))
    )


def career_consistency(history: Column, title: Column, n_tokens: Column) -> Column:
    months = F.filter(F.transform(history, lambda h: h["duration_months"]), lambda m: m.isNotNull())
    tenure = clamp(0.35 + 0.65 * soft_cap(F.coalesce(array_mean(months), F.lit(0.0)), 30.0))
    current = F.array_join(
        F.transform(F.filter(history, lambda h: h["is_current"]), lambda h: F.lower(h["title"])), " "
    )
    named = F.when((title != "") & F.contains(current, F.lower(title)), F.lit(1.0)).otherwise(F.lit(0.72))
    return F.when(
        F.coalesce(F.size(history), F.lit(0)) > 0, clamp(0.72 * tenure + 0.28 * named)
    ).otherwise(clamp(0.45 + 0.35 * soft_cap(n_tokens, 160.0)))


def _flag(flag: Column) -> Column:
    return F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))


def behavioral_score(s: Column) -> Column:
    verified = (_flag(s["email_ok"]) + _flag(s["phone_ok"]) + _flag(s["linked"])) / 3.0
    parts = (
        F.coalesce(s["response_rate"], F.lit(0.45)) * 0.24
        + (1.0 - soft_cap(non_zero_or(s["response_hours"], 168.0), 168.0)) * 0.10
        + clamp(non_zero_or(s["completeness"], 55.0) / 100) * 0.14
        + soft_cap(F.coalesce(s["views"], F.lit(0.0)), 80.0) * 0.10
        + soft_cap(F.coalesce(s["saved"], F.lit(0.0)), 12.0) * 0.10
        + F.coalesce(s["completion"], F.lit(0.58)) * 0.14
        + F.when(s["offer"] >= 0, s["offer"]).otherwise(F.lit(0.55)) * 0.08
        + F.when(s["github"] >= 0, clamp(s["github"] / 100)).otherwise(F.lit(0.45)) * 0.05
        + verified * 0.05
    )
    return F.when(s.isNull(), F.lit(0.55)).otherwise(clamp(parts))


def availability_score(s: Column, found: Column) -> Column:
    open_part = F.when(s["open_to_work"], F.lit(1.0)).otherwise(F.lit(0.48))
    notice = 1.0 - soft_cap(non_zero_or(s["notice"], 90.0), 120.0)
    moves = F.when(s["relocate"], F.lit(1.0)).otherwise(F.lit(0.62))
    known = clamp(0.48 * open_part + 0.34 * notice + 0.18 * moves)
    return F.when(s.isNotNull(), known).when(found, F.lit(0.65)).otherwise(F.lit(0.48))


def education_score(jd: Column, text: Column, token_set: Column) -> Column:
    low = F.lower(text)
    base = F.when(jd["has_education"], X.keyword_density(token_set, jd["education"])).otherwise(F.lit(0.55))
    tier = (
        F.when(F.contains(low, F.lit("tier_1")), F.lit(0.25))
        .when(F.contains(low, F.lit("tier_2")), F.lit(0.16))
        .when(F.contains(low, F.lit("tier_3")), F.lit(0.08))
        .otherwise(F.lit(0.0))
    )
    degree = F.when(low.rlike("(?U)" + C.DEGREE_PATTERN), F.lit(0.10)).otherwise(F.lit(0.0))
    return F.when(text == "", F.lit(0.48)).otherwise(clamp(base + tier + degree))


def location_score(jd: Column, token_set: Column, relocate: Column) -> Column:
    found = X.keyword_density(token_set, jd["locations"])
    return F.when(~jd["has_locations"], F.lit(0.68)).when(
        relocate, clamp(F.greatest(found, F.lit(0.72)))
    ).otherwise(clamp(found))


def production_score(jd: Column, hits: Column, n_metrics: Column) -> Column:
    measured = F.least(F.lit(1.0), n_metrics / 5)
    return clamp(0.78 * X.keyword_density(hits, jd["production"]) + 0.22 * measured)


def role_fit(jd: Column, role_tokens: Column, hits: Column) -> Column:
    query = jd["role"]
    # the role tokens may be the whole text's, so one hash set each
    share = lambda found: F.size(F.array_intersect(query, found)) / F.size(query)
    fit = clamp(
        0.70 * F.pow(share(role_tokens), F.lit(0.8))
        + 0.30 * F.pow(share(hits), F.lit(0.9))
    )
    return F.when(F.size(query) > 0, fit).otherwise(F.lit(0.58))


def integrity_flags(text: Column, lowered: Column, n_tokens: Column, completeness: Column, experience: Column) -> Column:
    """Data-quality warnings in a fixed order."""
    promo = sum((X.occurrences(lowered, w) for w in C.PROMOTIONAL_WORDS), F.lit(0)) / 3.0
    open_dates = (
        F.contains(F.lower(experience), F.lit("present")) & ~experience.rlike("(?U)" + C.YEAR_PATTERN)
    )
    return F.array_compact(
        F.array(
            F.when(F.length(text) < 80, F.lit(C.FLAG_SPARSE)),
            F.when(n_tokens < 20, F.lit(C.FLAG_LOW_DIVERSITY)),
            F.when(completeness < 45, F.lit(C.FLAG_LOW_COMPLETENESS)),
            F.when(open_dates, F.lit(C.FLAG_OPEN_DATES)),
            F.when(promo > 3, F.lit(C.FLAG_PROMOTIONAL)),
        )
    )


def integrity_score(flags: Column, n_tokens: Column) -> Column:
    base = 1.0 - F.least(F.lit(0.62), 0.16 * F.size(flags))
    return clamp(base * (0.86 + 0.14 * soft_cap(n_tokens, 180.0)))


def evidence_confidence(row: dict[str, Column]) -> Column:
    parts = [
        F.when(row["has_profile"], F.lit(1.0)).otherwise(F.lit(0.0)),
        soft_cap(row["n_skills"], 12.0),
        soft_cap(F.coalesce(F.size(row["history"]), F.lit(0)), 4.0),
        soft_cap(row["education_count"], 2.0),
        soft_cap(row["n_tokens"], 220.0),
        soft_cap(row["signal_keys"], 18.0),
    ]
    return clamp(sum(parts[1:], parts[0]) / 6.0)


def add_features(df: DataFrame) -> DataFrame:
    """All other single features; ``jd`` must be attached, see the module text."""
    jd = F.col("jd")
    c = {name: F.col(name) for name in df.columns}
    hits = F.array_intersect(jd["vocabulary"], c["tokens"])
    if "close_skills" in c:
        near = once(
            jd["skill_words"],
            lambda wanted: F.filter(c["close_skills"], lambda s: F.exists(s["focus"], lambda w: F.array_contains(wanted, w))),
        )
    else:
        near = near_skills(c["skills"], c["evidence"], jd["skill_words"])
    df = df.select("*", hits.alias("hits"), near.alias("near_skills"))
    hits = F.col("hits")
    record = F.struct(c["lowered"].alias("low"), hits.alias("hits"), F.col("near_skills").alias("skills"))
    match = lambda terms: once(
        record, lambda r: F.transform(terms, lambda t: term_match(t, r["low"], r["hits"], r["skills"]))
    )
    relevance = X.keyword_density(hits, jd["lexical"])
    location_tokens = F.when(c["_location"] != "", c["location_tokens"]).otherwise(c["tokens"])
    df = df.select(
        "*",
        match(jd["required"]).alias("required_scores"),
        match(jd["preferred"]).alias("preferred_scores"),
        X.present_terms(c["lowered"], hits, F.concat(jd["required"], jd["preferred"])).alias("present_terms"),
        relevance.alias("lexical_relevance"),
        role_fit(jd, c["role_tokens"], hits).alias("role_fit"),
        experience_score(c["years"], jd["min_years"]).alias("experience_score"),
        production_score(jd, hits, c["n_metrics"]).alias("production_score"),
        seniority_score(jd, c["years"], c["titles"]).alias("seniority_score"),
        education_score(jd, c["education_text"], c["education_tokens"]).alias("education_score"),
        location_score(jd, location_tokens, F.coalesce(c["signals"]["relocate"], F.lit(False))).alias("location_score"),
    )
    retrieval = attach_retrieval_score(df)
    semantic = semantic_rescale(retrieval)
    both = F.concat("required_scores", "preferred_scores")
    no_terms = F.size(both) == 0
    has_skills = F.size("evidence") > 0
    depth = (
        F.when(has_skills, skill_depth_of_records(F.col("evidence")))
        .when(no_terms, F.lit(0.45))
        .otherwise(soft_cap(F.size("present_terms"), 8.0))
    )
    return df.select(
        "*",
        _mean_or("required_scores", 0.58).alias("required_coverage"),
        _mean_or("preferred_scores", 0.55).alias("preferred_coverage"),
        F.when(~no_terms, mean_score(both))
        .when(has_skills, skill_depth_of_records(F.col("evidence")))
        .otherwise(F.lit(0.35))
        .alias("skill_overlap_score"),
        depth.alias("skill_depth"),
        retrieval.alias("retrieval"),
        semantic.alias("semantic_match"),
        integrity_score(F.col("integrity_flags"), F.col("n_tokens")).alias("integrity_score"),
    )


def attach_retrieval_score(df: DataFrame) -> Column:
    """A retrieval score given by the caller, else the lexical stand-in in [-1, 1]."""
    lexical = 2 * F.col("lexical_relevance") - 1
    if "retrieval_score" not in df.columns:
        return lexical
    given = F.col("retrieval_score")
    if isinstance(df.schema["retrieval_score"].dataType, T.MapType):  # one score per job
        given = F.try_element_at(given, F.col("jd")["jd_id"])
    return F.coalesce(given.cast("double"), lexical)


def _mean_or(scores: str, default: float) -> Column:
    return F.when(F.size(scores) > 0, mean_score(F.col(scores))).otherwise(F.lit(default))


# ---------------------------------------------------------------------------
# layer 4: groups and composite
# ---------------------------------------------------------------------------


def add_scores(df: DataFrame) -> DataFrame:
    """Technical fit, role relevance, hireability, gate and composite score."""
    c = F.col
    df = df.select(
        "*",
        (
            0.42 * c("required_coverage")
            + 0.20 * c("preferred_coverage")
            + 0.18 * c("skill_depth")
            + 0.12 * c("production_score")
            + 0.08 * c("lexical_relevance")
        ).alias("technical_fit"),
        (
            0.38 * c("role_fit")
            + 0.24 * c("semantic_match")
            + 0.20 * c("experience_score")
            + 0.10 * c("seniority_score")
            + 0.08 * c("career_score")
        ).alias("role_relevance"),
        (
            0.30 * c("behavioral_score")
            + 0.23 * c("availability_score")
            + 0.18 * c("location_score")
            + 0.16 * c("education_score")
            + 0.13 * c("evidence_confidence")
        ).alias("hireability"),
        (
            0.52 * c("required_coverage")
            + 0.22 * c("role_fit")
            + 0.16 * c("experience_score")
            + 0.10 * c("integrity_score")
        ).alias("must_have_gate"),
    )
    base = 0.55 * c("technical_fit") + 0.32 * c("role_relevance") + 0.13 * c("hireability")
    gated = base * (0.70 + 0.30 * c("must_have_gate")) * (0.84 + 0.16 * c("integrity_score"))
    return df.select("*", F.round(clamp(gated) * 100, 4).alias("composite_score"))


# breakdown name -> feature column
BREAKDOWN_SOURCE = {
    "skill_overlap": "skill_overlap_score",
    "required_skill_coverage": "required_coverage",
    "preferred_skill_coverage": "preferred_coverage",
    "relevant_experience": "experience_score",
    "production_experience_signals": "production_score",
    "seniority_match": "seniority_score",
    "career_progression": "career_score",
    "career_consistency": "career_score",
    "behavioral_signals": "behavioral_score",
    "availability": "availability_score",
    "education_relevance": "education_score",
    "location_match": "location_score",
    "fraud_detection": "integrity_score",
    "consistency_analysis": "career_score",
}


def feature(name: str) -> Column:
    """Unrounded value behind a breakdown name."""
    return F.col(BREAKDOWN_SOURCE.get(name, name))


def add_details(df: DataFrame) -> DataFrame:
    """Breakdown, matched and missing terms, strengths, concerns: for the shortlist."""
    jd = F.col("jd")
    breakdown = F.struct(*[F.round(feature(n) * 100, 2).alias(n) for n in C.BREAKDOWN])
    terms = F.concat(jd["required"], jd["preferred"])
    scores = F.concat("required_scores", "preferred_scores")

    def pick(items: Column, values: Column, keep) -> Column:
        chosen = once(values, lambda v: F.filter(items, lambda t, i: keep(F.get(v, i))))
        return F.transform(chosen, lambda t: t["term"])

    df = df.select(
        "*",
        breakdown.alias("breakdown"),
        pick(terms, scores, lambda s: s >= 0.52).alias("matched_skills"),
        pick(terms, scores, lambda s: s < 0.42).alias("missing_skills"),
        pick(jd["required"], F.col("required_scores"), lambda s: s < 0.42).alias("missing_required"),
    )
    return df.select("*", strengths().alias("strengths"), concerns().alias("concerns"))


def strengths() -> Column:
    n = F.size("matched_skills")
    first = F.when(n > 0, F.concat(F.lit("Matches "), n.cast("string"), F.lit(" desired skills")))
    labels = [F.when(feature(k) >= 0.72, F.lit(C.STRENGTH_LABELS[k])) for k in C.BREAKDOWN if k in C.STRENGTH_LABELS]
    return F.slice(F.array_compact(F.array(first, *labels)), 1, 7)


def concerns() -> Column:
    missing = F.transform(
        F.slice("missing_required", 1, 4), lambda s: F.concat(F.lit("Missing required skill: "), s)
    )
    labels = [F.when(feature(k) <= 0.32, F.lit(label)) for k, label in C.CONCERN_LABELS.items()]
    return F.slice(F.concat(missing, "integrity_flags", F.array_compact(F.array(*labels))), 1, 8)


def score(profiles: DataFrame, jobs: list[JobSpec]) -> DataFrame:
    """Profiles x jobs with every feature and the composite score; no shuffle."""
    df = add_close_skills(add_record_features(add_role_tokens(add_tokens(profiles))), jobs)
    df = add_features(with_jobs(df, jobs))
    return add_scores(df).withColumn("jd_id", F.col("jd")["jd_id"])
