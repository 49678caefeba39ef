"""One readable reason per shortlisted row, from evidence columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.functions import text as X
from rankloom.functions.numeric import array_mean, once


def _order_of(skill: Column) -> Column:
    level = F.lower(F.coalesce(skill["proficiency"], F.lit("")))
    out = F.lit(0)
    for name, weight in C.PROFICIENCY_ORDER.items():
        out = F.when(level == name, F.lit(weight)).otherwise(out)
    return F.struct(
        out.alias("level"),
        F.coalesce(skill["duration_months"], F.lit(0.0)).alias("months"),
        F.coalesce(skill["endorsements"], F.lit(0.0)).alias("endorsed"),
    )


def sort_skills(skills: Column) -> Column:
    """Skills by level, months and endorsements, all descending; ties keep their order."""
    keyed = F.transform(
        skills, lambda s, i: F.struct(_order_of(s).alias("key"), (-i).alias("place"), s.alias("skill"))
    )
    return F.transform(F.sort_array(keyed, asc=False), lambda k: k["skill"])


def matched_skill_records(skills: Column, matched: Column) -> Column:
    """Skill records whose canonical name contains, or is part of, a matched term."""
    wanted = F.transform(matched, X.canonical_skill)
    named = F.transform(
        skills,
        lambda s: F.struct(X.canonical_skill(F.coalesce(s["name"], F.lit(""))).alias("name"), s.alias("skill")),
    )
    related = once(
        wanted,
        lambda terms: F.filter(
            named,
            lambda n: (n["name"] != "")
            & F.exists(terms, lambda w: F.contains(w, n["name"]) | F.contains(n["name"], w)),
        ),
    )
    return sort_skills(F.transform(related, lambda n: n["skill"]))


def skill_record_label(skill: Column) -> Column:
    level = F.nullif(X.strip(F.coalesce(skill["proficiency"], F.lit(""))), F.lit(""))
    months, endorsed = skill["duration_months"], skill["endorsements"]
    details = F.array_join(
        F.array_compact(
            F.array(
                level,
                F.when(months >= 12, F.concat(months.cast("long").cast("string"), F.lit(" mo"))),
                F.when(endorsed > 0, F.concat(endorsed.cast("long").cast("string"), F.lit(" endorsements"))),
            )
        ),
        ", ",
    )
    name = X.strip(skill["name"])
    return F.when(details != "", F.concat(name, F.lit(" ("), details, F.lit(")"))).otherwise(name)


def skill_phrase(matched: Column, skills: Column) -> Column:
    """Up to three skills, preferring the matched ones; empty without skills."""
    has_match = F.size(matched) > 0
    chosen = F.slice(F.when(has_match, matched).otherwise(sort_skills(skills)), 1, 3)
    labels = F.transform(F.filter(chosen, lambda s: s["name"].isNotNull()), skill_record_label)
    n_ai = F.size(F.filter(skills, lambda s: X.is_ai_skill(F.coalesce(s["name"], F.lit("")))))
    prefix = (
        F.when(has_match, F.concat(F.size(matched).cast("string"), F.lit(" matched JD skills")))
        .when(n_ai > 0, F.concat(n_ai.cast("string"), F.lit(" AI/data skills")))
        .otherwise(F.lit("top profile skills"))
    )
    return F.when(F.size(chosen) > 0, F.concat(prefix, F.lit(": "), F.array_join(labels, ", "))).otherwise(F.lit(""))


def _whole(value: Column) -> Column:
    """No decimals, halves to even."""
    return F.bround(value, 0).cast("long").cast("string")


def assessment_phrase(scores: Column) -> Column:
    n = F.size(scores)
    said = F.concat(n.cast("string"), F.lit(" skill assessments averaging "), _whole(array_mean(scores)), F.lit("/100"))
    return F.when(n > 0, said).otherwise(F.lit(""))


def signal_phrase(s: Column) -> Column:
    parts = F.array(
        F.concat(F.lit("response rate "), F.format_string("%.2f", F.bround(s["response_rate"], 2))),
        F.concat(s["notice"].cast("long").cast("string"), F.lit("d notice")),
        F.when(s["work_mode"] != "", F.concat(s["work_mode"], F.lit(" work preference"))),
        F.when(s["github"] >= 0, F.concat(F.lit("GitHub activity "), _whole(s["github"]), F.lit("/100"))),
    )
    # format_string prints "null" for null, so absent numbers are removed by hand
    parts = F.filter(
        F.array(
            F.when(s["response_rate"].isNotNull(), F.get(parts, F.lit(0))),
            F.get(parts, F.lit(1)),
            F.get(parts, F.lit(2)),
            F.get(parts, F.lit(3)),
        ),
        lambda p: p.isNotNull(),
    )
    return F.when(s.isNull(), F.lit("")).otherwise(F.array_join(F.slice(parts, 1, 3), ", "))


def gap_phrase(missing: Column) -> Column:
    two = F.array_join(F.transform(F.slice(missing, 1, 2), X.skill_label), ", ")
    return F.when(F.size(missing) > 0, F.concat(F.lit("gaps: "), two)).otherwise(
        F.lit("no major JD skill gaps flagged")
    )


def lead_phrase(title: Column, years: Column, location: Column) -> Column:
    """Title with years, or with the location where years are missing."""
    spoken = F.concat(F.format_string("%.1f", F.bround(years, 1)), F.lit(" yrs"))
    shown = F.when(years.isNotNull(), spoken).otherwise(F.nullif(location, F.lit("")))
    return F.when(shown.isNotNull(), F.concat(title, F.lit(" with "), shown)).otherwise(title)


def evidence_reason(row) -> Column:
    """Short form from profile, skills and signals; empty when there are none."""
    known = row("has_profile") | (row("signal_keys") > 0) | (F.size(row("listed_skills")) > 0)
    matched = matched_skill_records(row("listed_skills"), row("matched_skills"))
    parts = F.array(
        lead_phrase(row("reason_title"), row("profile_years"), row("reason_location")),
        skill_phrase(matched, row("listed_skills")),
        assessment_phrase(F.coalesce(row("signals")["assessments"], F.array().cast("array<double>"))),
        signal_phrase(row("signals")),
        gap_phrase(row("missing_skills")),
    )
    said = F.array_join(F.filter(parts, lambda p: p != ""), "; ")
    return F.when(known, F.concat(said, F.lit("."))).otherwise(F.lit(""))


def _bullets(title: str, items: Column) -> Column:
    return F.concat(F.lit(title + ":\n- "), F.array_join(items, "\n- "))


def opening(row) -> Column:
    first = X.skill_label(F.get(row("matched_skills"), F.lit(0)))
    some = F.size(row("matched_skills")) > 0
    return (
        F.when(some & (row("breakdown")["relevant_experience"] >= 75), F.format_string(C.OPENING_STRONG, first))
        .when(some, F.format_string(C.OPENING_RELEVANT, first))
        .otherwise(F.lit(C.OPENING_PARTIAL))
    )


def strength_bullets(row) -> Column:
    b = row("breakdown")
    matched = row("matched_skills")
    lead = F.array_compact(
        F.array(
            F.when(b["seniority_match"] >= 75, F.lit(C.STRENGTH_SENIOR)),
            F.when((b["career_progression"] >= 75) | (b["career_consistency"] >= 75), F.lit(C.STRENGTH_CAREER)),
            F.when((b["required_skill_coverage"] >= 70) | (b["skill_overlap"] >= 70), F.lit(C.STRENGTH_CORE)),
            F.when(b["production_experience_signals"] >= 60, F.lit(C.STRENGTH_DELIVERY)),
            F.when(
                F.size(matched) > 0,
                F.concat(F.lit("Relevant skills include "), F.array_join(F.slice(matched, 1, 5), ", ")),
            ),
        )
    )
    more = F.filter(row("strengths"), lambda s: ~F.contains(F.lower(s), F.lit("semantic")))
    items = F.slice(F.array_distinct(F.concat(lead, more)), 1, 4)
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(C.STRENGTH_NONE)))


def concern_bullets(row) -> Column:
    gone = lambda s: F.concat(F.lit("No evidence of "), s, F.lit(" experience"))
    prefix = "Missing required skill: "
    known = F.transform(
        row("concerns"),
        lambda s: F.when(s.startswith(prefix), gone(X.strip(F.substring(s, F.lit(len(prefix) + 1), F.length(s))))).otherwise(s),
    )
    missing = F.transform(F.slice(row("missing_skills"), 1, 5), gone)
    items = F.slice(F.array_distinct(F.concat(missing, known)), 1, 4)
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(C.CONCERN_NONE)))


def overall(score: Column) -> Column:
    """The concern list is never empty, so the top band always mentions onboarding."""
    return (
        F.when(score >= 80, F.lit(C.OVERALL_80))
        .when(score >= 70, F.lit(C.OVERALL_70))
        .when(score >= 55, F.lit(C.OVERALL_55))
        .otherwise(F.lit(C.OVERALL_LOW))
    )


def fallback_reason(row) -> Column:
    """Long form in four paragraphs."""
    return F.concat_ws(
        "\n\n",
        opening(row),
        _bullets("Key strengths", strength_bullets(row)),
        _bullets("Potential concerns", concern_bullets(row)),
        F.concat(F.lit("Overall assessment:\n"), overall(row("composite_score"))),
    )


def add_reasoning(df: DataFrame) -> DataFrame:
    """Short reason where there is evidence, long form otherwise."""
    df = df.withColumn("_short", evidence_reason(F.col))
    return df.withColumn(
        "reasoning", F.when(F.col("_short") != "", F.col("_short")).otherwise(fallback_reason(F.col))
    ).drop("_short")
