"""Queries that read their rows twice compute them once; a batch of few files is scored by all cores."""

import json

from pyspark.sql import functions as F

from rankloom import JobSpec, SchemaMap
from rankloom.operators import features
from rankloom.plans import candidates as view
from rankloom.plans.queries import QUERIES, registry
from rankloom.plans.queries import ranking as queries
from rankloom.plans.ranking import score_all
from rankloom.streaming import arrivals

PEOPLE = """key long, candidate_id string, profile struct<anonymized_name:string,current_title:string,years_of_experience:double,location:string,country:string>,
summary string, skills array<struct<name:string,proficiency:string,duration_months:int,endorsements:int>>,
career_history array<struct<title:string,duration_months:int,is_current:boolean>>, education array<struct<degree:string,tier:string>>,
signals struct<open_to_work_flag:boolean>"""


def people(spark):
    skills = [[("red widget", "expert", 40, 3), ("Cold Spring", "beginner", 4, 1)], [("small ring", None, None, 2)], []]
    rows = [(i, f"C{i}", (f"N{i}", "Data Analyst", float(i), "nation-3", "ASIA"), "x", skills[i % 3], [], [], (i % 2 == 0,)) for i in range(9)]
    return spark.createDataFrame([*rows, rows[4]], PEOPLE)  # a key may repeat


def counted(spark, df, key):
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    kind = df.schema[key].dataType
    return df.withColumn(key, F.udf(look, kind).asNondeterministic()(key)), seen


def test_shortlist_of_the_lookup_is_computed_once(spark, monkeypatch):
    rows = spark.createDataFrame([("star", "a", 2.0), ("star", "b", 1.0), ("other", "b", 3.0), ("other", None, 1.0)], "jd_id string, candidate_id string, composite_score double")
    rows, seen = counted(spark, rows, "jd_id")
    monkeypatch.setattr(queries, "ranked", lambda spark, sf: rows)
    found = QUERIES["candidate_lookup"](spark, "own").collect()
    assert sorted(map(tuple, found)) == [("other", "b", 3.0), ("star", "b", 1.0)]
    assert seen.value == 4


def test_records_of_backfill_and_funnel_are_computed_once(spark, monkeypatch):
    rows, seen = counted(spark, people(spark), "key")
    paths = SchemaMap.from_struct(spark, people(spark).select(*view.RECORD).schema)
    for module in (registry, queries):
        monkeypatch.setattr(module, "candidates", lambda spark, sf: rows)
    monkeypatch.setattr(registry, "schema_map", lambda spark, sf: paths)
    filled = QUERIES["raw_backfill"](spark, "own-backfill").collect()
    assert len(filled) == 4 * (8 + 2 * 2) and all(r.n_chars > 0 for r in filled)
    assert seen.value == 10
    assert len(QUERIES["funnel_narrow"](spark, "own-funnel").collect()) == 4 * 10
    assert seen.value == 20


def test_every_scored_row_is_ranked_and_scored_once(spark, monkeypatch):
    """More rows of a job than any shortlist holds; ids repeat and are null."""
    first = people(spark)
    paths = SchemaMap.from_struct(spark, first.select(*view.RECORD).schema)
    number = F.col("key") + 9 * F.col("n")
    name = F.when(number % 100 == 0, None).otherwise(F.format_string("C%03d", number % 590))
    rows, seen = counted(spark, first.crossJoin(spark.range(70).toDF("n")).withColumn("candidate_id", name).drop("n").coalesce(4), "candidate_id")
    for module in (registry, queries):
        monkeypatch.setattr(module, "candidates", lambda spark, sf: rows)
    monkeypatch.setattr(registry, "schema_map", lambda spark, sf: paths)
    found = sorted(map(tuple, QUERIES["rank_rows"](spark, "own-ranks").collect()), key=repr)
    assert len(found) == 4 * 700 and seen.value == 700
    want, scores = [], [tuple(r) for r in registry.scored(spark, "own-ranks").select("jd_id", "candidate_id", "composite_score").collect()]
    for job in {s[0] for s in scores}:
        own = sorted((s for s in scores if s[0] == job), key=lambda s: (-s[2], s[1] or ""))
        want += [(job, s[1], n) for n, s in enumerate(own, 1)]
    assert found == sorted(want, key=repr)


def test_close_skills_of_many_jobs_give_the_scores_of_one_job(spark):
    rows = people(spark)
    paths = SchemaMap.from_struct(spark, rows.select(*view.RECORD).schema)
    profiles = registry.profiles_from_columns(rows, paths, record=view.RECORD)
    jobs = [JobSpec("a", required_skills=("red widget", "spring")), JobSpec("b", preferred_skills=("ring tool",)), JobSpec("c")]
    columns = ["jd_id", "candidate_id", "required_scores", "preferred_scores", "present_terms", "composite_score"]
    together = sorted(map(repr, score_all(profiles, jobs).select(*columns).collect()))
    apart = sorted(repr(r) for job in jobs for r in score_all(profiles, [job]).select(*columns).collect())
    # without the column every job tokenises the names for itself
    alone = features.add_record_features(features.add_role_tokens(features.add_tokens(profiles)))
    alone = features.add_scores(features.add_features(features.with_jobs(alone, jobs))).withColumn("jd_id", F.col("jd.jd_id"))
    assert together == apart == sorted(map(repr, alone.select(*columns).collect()))
    assert "close_skills" in features.score(profiles, jobs).columns


def test_batch_of_one_file_is_spread_and_each_line_looked_at_once(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"candidate_id": f"C{i}", "skills": ["ring"]}) for i in range(40)]
    (folder / "one.jsonl").write_text("\n".join([*lines, '{"candidate_id": ', "7", "", '{"a": 1} x']))
    partitions, real = [], arrivals.stream_scores
    monkeypatch.setattr(arrivals, "stream_scores", lambda records, *a: partitions.append(records.rdd.getNumPartitions()) or real(records, *a))
    schema = SchemaMap.from_json_schema(spark, {"properties": {"skills": {"type": "array"}}})
    state, rejects = str(tmp_path / "state"), str(tmp_path / "rejects")
    arrivals.rank_arrivals(spark, str(folder), [JobSpec(required_skills=("ring",))], schema, state, str(tmp_path / "cp"), rejects=rejects).awaitTermination()
    assert partitions and min(partitions) >= spark.sparkContext.defaultParallelism
    assert arrivals.current_shortlist(spark, state).count() == 40
    bad = arrivals.rejected_lines(spark, rejects)
    assert sorted(r.raw for r in bad.collect()) == ['{"a": 1} x', '{"candidate_id": '] and "_sound" not in spark.read.parquet(rejects).columns
