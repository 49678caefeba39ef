"""Observed counts, explanation requests, running shortlists with a side table."""

import json
import os

import pytest

from rankloom import JobSpec, jobs as jobs_module
from rankloom.operators import reports
from rankloom.operators.profile import profiles_from_json
from rankloom.operators.schema_map import SchemaMap
from rankloom.plans.ranking import rank, write_ranking
from rankloom.sources.writers import write_jobs
from rankloom.streaming import arrivals

SCHEMA = {"properties": {"candidate_id": {"type": "string"}, "headline": {"type": "string"}, "skills": {"type": "array"}}}
JOBS = [JobSpec(jd_id="b", title="Tuner", required_skills=("piano",), experience_years_min=3), JobSpec(jd_id='a"é', preferred_skills=("tuning",))]


def lines(first, last):
    return [json.dumps({"candidate_id": f"p{i:03d}", "headline": "piano " * (i % 7), "skills": ["tuning"] * (i % 2)}) for i in range(first, last)]


def profiles(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    from rankloom.operators.profile import parse_records

    return profiles_from_json(parse_records(df), SchemaMap.from_json_schema(spark, SCHEMA))


def test_counts_are_observed_while_writing(spark, tmp_path):
    rows = profiles(spark, lines(0, 40)).repartition(4)
    path = str(tmp_path / "ranking")
    found = [tuple(r) for r in write_ranking(rows, JOBS, path, k=7).collect()]
    assert found == [("b", 40, 40, 7), ('a"é', 40, 40, 7)]
    written = spark.read.parquet(path)
    want = rank(rows, JOBS, k_features=7).ranked
    key = lambda df: sorted(map(tuple, df.select("jd_id", "candidate_id", "composite_score").collect()))
    assert key(written) == key(want)


def test_counts_of_several_passes_and_of_nothing(spark, tmp_path, monkeypatch):
    rows = profiles(spark, lines(0, 10))
    assert write_ranking(rows, [], str(tmp_path / "none")).collect() == []
    empty = write_ranking(rows.where("false"), JOBS, str(tmp_path / "empty"), k=3)
    assert [tuple(r) for r in empty.collect()] == [("b", 0, 0, 0), ('a"é', 0, 0, 0)]
    monkeypatch.setattr(jobs_module, "MAX_LITERAL_BYTES", 10)  # one pass a job
    found = write_ranking(rows, JOBS, str(tmp_path / "two"), k=3)
    assert [tuple(r) for r in found.collect()] == [("b", 10, 10, 3), ('a"é', 10, 10, 3)]


def test_one_explanation_request_per_job(spark):
    spare = JobSpec(jd_id="spare")
    ranked = rank(profiles(spark, lines(0, 30)), JOBS).ranked
    found = {r.jd_id: r for r in reports.explanation_requests(ranked, [*JOBS, spare], k=5).collect()}
    assert set(found) == {"b", 'a"é', "spare"}
    for job in JOBS:
        body = json.loads(found[job.jd_id].request)
        assert body["jd_intelligence"] == json.loads(json.dumps(job.as_dict()))
        best = ranked.where(ranked.jd_id == job.jd_id).orderBy(ranked.composite_score.desc(), "candidate_id").limit(5).collect()
        assert [c["candidate_id"] for c in body["ranked_candidates"]] == [r.candidate_id for r in best]
        assert list(body["ranked_candidates"][0]) == [*reports.PAYLOAD_FIELDS, "scoring_reasoning"]
        assert found[job.jd_id].n_candidates == 5
    assert json.loads(found["spare"].request)["ranked_candidates"] == [] and found["spare"].n_candidates == 0


def test_whole_years_are_written(spark, tmp_path):
    write_jobs(spark, JOBS, str(tmp_path / "jobs"))
    years = {json.loads(r.value)["jd_id"]: json.loads(r.value)["experience_years_min"] for r in spark.read.text(str(tmp_path / "jobs")).collect()}
    assert years == {"b": 3.0, 'a"é': None}


BAD = ['{"candidate_id": "cut"', '{"candidate_id": "p999"} x', "nonsense"]


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(rows) + "\n")


def test_stream_restarts_and_keeps_few_folders(spark, tmp_path):
    source, state, side = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "bad")
    paths = SchemaMap.from_json_schema(spark, SCHEMA)
    start = lambda: arrivals.rank_arrivals(
        spark, source, JOBS, paths, state, str(tmp_path / "checkpoint"), rejects=side, k=6, max_files=1, keep_batches=2
    ).awaitTermination()
    for i in range(4):
        put(source, f"{i}.jsonl", lines(i * 10, i * 10 + 10) + (["", "  ", "5", '"text"', BAD[i]] if i < 3 else []))
    start()
    put(source, "4.jsonl", lines(40, 60))
    start()  # goes on from the checkpoint
    start()  # nothing new

    want = rank(profiles(spark, lines(0, 60)), JOBS, k_features=6).ranked
    key = lambda df: sorted(map(tuple, df.select("jd_id", "candidate_id", "composite_score").collect()))
    assert key(arrivals.current_shortlist(spark, state)) == key(want)
    assert len([n for n in os.listdir(state) if n.startswith("batch=")]) == 2
    bad = arrivals.rejected_lines(spark, side).collect()
    assert sorted(r.raw for r in bad) == sorted(BAD) and len({r.batch for r in bad}) == 3


def test_a_replayed_batch_gives_the_same_rows(spark, tmp_path):
    paths = SchemaMap.from_json_schema(spark, SCHEMA)
    state = str(tmp_path / "state")
    scores = lambda a, b: arrivals.stream_scores(
        arrivals.sound_records(spark.createDataFrame([(r, "f") for r in lines(a, b)], "raw string, source_file string")), JOBS, paths
    )
    merge = lambda n, df: arrivals._merge(df, n, state, 5, "id", 2)
    for n in range(4):
        merge(n, scores(n * 10, n * 10 + 10))
    key = lambda: sorted(map(tuple, arrivals.current_shortlist(spark, state).select("jd_id", "candidate_id", "composite_score").collect()))
    before = key()
    merge(3, scores(30, 40))  # the last batch once more, after a crash
    assert key() == before and sorted(os.listdir(state)) == ["batch=2", "batch=3"]


def test_no_malformed_lines_and_too_few_folders(spark, tmp_path):
    source, side = str(tmp_path / "in"), str(tmp_path / "bad")
    put(source, "0.jsonl", lines(0, 3))
    paths = SchemaMap.from_json_schema(spark, SCHEMA)
    folders = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    arrivals.rank_arrivals(spark, source, JOBS, paths, *folders, rejects=side).awaitTermination()
    assert arrivals.rejected_lines(spark, side).count() == 0
    with pytest.raises(ValueError, match="2 batches"):
        arrivals.rank_arrivals(spark, source, JOBS, paths, *folders, keep_batches=1)
