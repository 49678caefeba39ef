"""Export rows: limit, columns, ties, normalised scores, reasons, CSV."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from rankloom import JobSpec
from rankloom import constants as C
from rankloom.operators import reasons, reports, topk
from rankloom.operators.profile import SKILL
from rankloom.sources.writers import EXPORT_COLUMNS, write_ranked_csv

_SIGNALS = (
    "struct<" + ",".join(f"{k}:double" for k in C.SIGNAL_NUMBERS) + "," + ",".join(f"{k}:boolean" for k in C.SIGNAL_FLAGS)
    + ",work_mode:string,assessments:array<double>>"
)
_BREAKDOWN = "struct<" + ",".join(f"{n}:double" for n in C.BREAKDOWN) + ">"


def scores(spark, rows, breakdown=None, **extra):
    """Ranked rows with a matched skill and no evidence unless given."""
    df = spark.createDataFrame([Row(candidate_id=i, composite_score=float(s)) for i, s in rows])
    values = {"skill_overlap": 95.0, **(breakdown or {})}
    base = {
        "jd_id": "'j'",
        "matched_skills": "array('Python')",
        "missing_skills": "cast(array() as array<string>)",
        "strengths": "array('Strong Python experience')",
        "concerns": "cast(array() as array<string>)",
        "breakdown": f"cast(named_struct({','.join(f'''{n!r}, {values.get(n, 0.0)}D''' for n in C.BREAKDOWN)}) as {_BREAKDOWN})",
        "has_profile": "false",
        "signal_keys": "0",
        "signals": f"cast(null as {_SIGNALS})",
        "listed_skills": f"cast(array() as array<{SKILL}>)",
        "reason_title": "'Candidate'",
        "reason_location": "''",
        "profile_years": "cast(null as double)",
    }
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in {**base, **extra}.items()])


def export(df, k=C.TOP_K_EXPORT):
    return reports.export_rows(df, k).orderBy("rank").collect()


def test_export_is_limited_and_ranked(spark):
    rows = export(scores(spark, [(str(i), 91.5) for i in range(105)]))
    assert [r["rank"] for r in rows] == list(range(1, 101))
    assert {r["score"] for r in rows} == {"1.00000000"}


def test_ties_go_by_id(spark):
    rows = export(scores(spark, [("bed-2", 91.5), ("bed-1", 91.5)]))
    assert [r["candidate_id"] for r in rows] == ["bed-1", "bed-2"]


def test_scores_are_normalised_over_the_export_only(spark):
    given = [("a", 80.0), ("b", 76.0), ("c", 72.0)]
    assert [r["score"] for r in export(scores(spark, given))] == ["1.00000000", "0.55000000", "0.10000000"]
    assert [r["score"] for r in export(scores(spark, [*given, ("d", 3.0)]), 3)] == ["1.00000000", "0.55000000", "0.10000000"]


def test_long_reason_without_evidence(spark):
    text = export(scores(spark, [("abc", 91.5)]))[0]["reasoning"]
    assert text.startswith("Candidate demonstrates relevant Python capability for this role.\n\nKey strengths:\n- ")
    assert "- Strong alignment with core role requirements\n- Relevant skills include Python\n- Strong Python experience" in text
    assert "Potential concerns:\n- No major concerns surfaced from the scoring evidence" in text
    assert text.endswith("Overall assessment:\n" + C.OVERALL_80)


def test_short_reason_from_evidence(spark):
    skills = (
        f"cast(array(named_struct('name','Mycology','proficiency','advanced','duration_months',26D,'endorsements',37D),"
        f"named_struct('name','Weeding','proficiency','intermediate','duration_months',35D,'endorsements',6D)) as array<{SKILL}>)"
    )
    values = {"response_rate": "0.34D", "notice": "60D", "work_mode": "'onsite'", "assessments": "array(50D)"}
    names = [*C.SIGNAL_NUMBERS, *C.SIGNAL_FLAGS, "work_mode", "assessments"]
    signals = f"cast(named_struct({','.join(f'''{n!r},{values.get(n, 'null')}''' for n in names)}) as {_SIGNALS})"
    df = scores(
        spark,
        [("bed-9", 88.0)],
        matched_skills="array('Python', 'Mycology')",
        missing_skills="array('Soil tests')",
        has_profile="true",
        signal_keys="4",
        listed_skills=skills,
        signals=signals,
        reason_title="'Greenhouse Manager'",
        reason_location="'Kew, England'",
        profile_years="6.9D",
    )
    assert export(df)[0]["reasoning"] == (
        "Greenhouse Manager with 6.9 yrs; 1 matched JD skills: Mycology (advanced, 26 mo, 37 endorsements); "
        "1 skill assessments averaging 50/100; response rate 0.34, 60d notice, onsite work preference; gaps: Soil tests."
    )


def test_a_term_of_filler_words_matches_every_skill(spark):
    df = spark.range(1).select(
        F.expr(f"cast(array(named_struct('name','SQL','proficiency',null,'duration_months',3D,'endorsements',0D)) as array<{SKILL}>)").alias("s"),
        F.array(F.lit("hands-on production")).alias("m"),
    )
    found = df.select(reasons.matched_skill_records(F.col("s"), F.col("m")).alias("f")).first()["f"]
    assert [s["name"] for s in found] == ["SQL"]


def test_equal_skills_keep_their_order(spark):
    item = "named_struct('name','{}','proficiency','{}','duration_months',{}D,'endorsements',1D)"
    items = ",".join(item.format(*x) for x in [("a", "x", 5), ("b", "Expert", 1), ("c", "x", 5), ("d", "expert", 1)])
    df = spark.range(1).select(F.expr(f"cast(array({items}) as array<{SKILL}>)").alias("s"))
    names = df.select(F.transform(reasons.sort_skills(F.col("s")), lambda s: s["name"]).alias("n")).first()["n"]
    assert names == ["b", "d", "a", "c"]


def test_csv_round_trip_with_quotes_and_newlines(spark, tmp_path):
    rows = spark.createDataFrame(
        [("j", "a", 1, "1.00000000", 'said "x",\nthen\n- y'), ("j", "b", 2, "0.10000000", "plain")],
        "jd_id string, candidate_id string, rank int, score string, reasoning string",
    )
    path = str(tmp_path / "out")
    write_ranked_csv(rows, path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    assert back.columns == EXPORT_COLUMNS
    assert [r["reasoning"] for r in back.orderBy("rank").collect()] == ['said "x",\nthen\n- y', "plain"]


def test_last_explanation_wins(spark):
    ranked = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    notes = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "candidate_id string, summary string, pos int")
    rows = {r["candidate_id"]: r["explanation"] for r in reports.explanation_lookup(ranked, notes, "pos").collect()}
    assert rows["a"]["summary"] == "new" and rows["b"] is None


def test_job_spec_is_plain_configuration():
    assert JobSpec(title="x").as_dict()["required_skills"] == ()
    assert len(topk.score_order()) == 2
