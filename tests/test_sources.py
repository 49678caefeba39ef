"""Readers: JSONL plain and gzip, arrays, CSV, line numbers over splits, bad lines."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankloom import JobSpec, SchemaMap
from rankloom.jobs import jobs_from_frame
from rankloom.operators.schema_map import paths_of_struct, paths_of_variants, struct_of_json_schema
from rankloom.plans.ranking import rank_files
from rankloom.sources import readers
from rankloom.sources.writers import write_jobs


def ids(df):
    return [(r["row_id"], json.loads(r["raw"]).get("id")) for r in df.orderBy("row_id").collect()]


def test_jsonl_plain_and_gzip(spark, tmp_path):
    lines = b'{"id":"c1","beds":[4]}\n\n[1,2]\n  \n{"id":"c2"}\n7\n'
    (tmp_path / "a.jsonl").write_bytes(lines)
    with gzip.open(tmp_path / "b.jsonl.gz", "wb") as f:
        f.write(lines)
    for name in ("a.jsonl", "b.jsonl.gz"):
        path = str(tmp_path / name)
        assert ids(readers.read_jsonl(spark, path)) == [(1, "c1"), (5, "c2")]
        assert ids(readers.read_jsonl(spark, path, dense_ids=True)) == [(1, "c1"), (2, "c2")]


def test_malformed_line_stops_or_is_quarantined(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id":"c1"}\n{"id":"c2"} {"id":"x"}\n{"id":"c3"}\n{"id": \n{"id":"c5"}, 1\n')
    with pytest.raises(Exception, match="Invalid JSONL on line 2"):
        readers.read_jsonl(spark, str(path)).collect()
    assert ids(readers.read_jsonl(spark, str(path), mode="DROP")) == [(1, "c1"), (3, "c3")]
    assert sorted(r["row_id"] for r in readers.quarantine(spark, str(path)).collect()) == [2, 4, 5]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 1500)):
        (tmp_path / name).write_text("".join(f'{{"n": {i + 1}}}\n' + ("\n" if i % 10 == 0 else "") for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_jsonl(spark, str(tmp_path)).persist()
        assert df.rdd.getNumPartitions() >= 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5500
    for r in rows:
        n = json.loads(r["raw"])["n"]
        assert r["row_id"] == n + (n + 8) // 10


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"x","b":{"z":1,"a":2}}, 5, {"id":"y"}]')
    assert ids(readers.read_json_array(spark, str(tmp_path / "a.json"))) == [(1, "x"), (3, "y")]
    (tmp_path / "b.json").write_text('{"candidates": [{"id":"z"}]}')
    assert ids(readers.read_json_array(spark, str(tmp_path / "b.json"))) == [(1, "z")]


def test_csv_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,years,note\nc1,3,"a, b"\nc2,,x\n')
    rows = [json.loads(r["raw"]) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()]
    assert rows == [{"id": "c1", "years": 3, "note": "a, b"}, {"id": "c2", "note": "x"}]


def test_jobs_round_trip_and_defaults(spark, tmp_path):
    job = JobSpec(jd_id="j", title="T", required_skills=("a", "b"), experience_years_min=2.5)
    path = str(tmp_path / "jobs")
    write_jobs(spark, [job], path)
    assert jobs_from_frame(readers.read_jobs(spark, path)) == [job]
    (tmp_path / "short.json").write_text('{\n  "title": "Only a title"\n}')
    short = jobs_from_frame(readers.read_jobs(spark, str(tmp_path / "short.json")))[0]
    assert (short.jd_id, short.title, short.required_skills) == ("short.json", "Only a title", ())


def test_schema_documents(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"type": "array"}')
    with pytest.raises(ValueError):
        readers.read_schema(spark, str(path))
    docs = spark.createDataFrame([('{"type":"object"}',), ("{}",), ("[]",), ('{"type":"array"}',), ("nope",)], "raw string")
    assert [r["is_valid"] for r in readers.valid_schema_documents(docs).collect()] == [True, True, False, False, False]


def test_schema_map(spark):
    doc = {
        "type": "object",
        "properties": {
            "member": {"type": "object", "properties": {"nick_name": {"type": "string"}}},
            "tool_skills": {"type": "array", "items": {"type": "string"}},
            "past_employment": {"type": "array", "items": {"type": "object", "properties": {"months": {"type": "number"}}}},
            "grid": {"type": "array", "items": {"type": "array", "items": {"properties": {"x": {}}}}},
        },
    }
    m = SchemaMap.from_json_schema(spark, doc)
    assert "$.tool_skills" in m["skills"] and "$.past_employment" in m["experience"]
    assert "$.grid[]" in m.raw_paths and not any(p.startswith("$.grid[].") for p in m.raw_paths)
    assert m.confidence("skills") == pytest.approx(2 / 3) and m.confidence("education") == 0.0
    assert paths_of_struct(struct_of_json_schema(doc)) == list(m.raw_paths)
    df = spark.createDataFrame([('{"member":{"nick_name":"Hazel"},"tool_skills":["Grafting"]}',)], "raw string").withColumn(
        "v", F.parse_json("raw")
    )
    from rankloom.functions.json_text import resolve_paths, resolved_text

    text = df.select(resolved_text(resolve_paths(F.col("v"), m["identity"]))).first()[0]
    assert text.split()[0] == "Hazel"
    assert "$.member.nick_name" in paths_of_variants(df, "v")


def test_unusual_keys(spark):
    from rankloom.functions.json_text import resolve_paths

    keys = {"AVOIDED": "x", "it's": "y", "a b": "z", "OBJECT": {"VOID": None}}
    df = spark.createDataFrame([(json.dumps(keys),)], "raw string").withColumn("v", F.parse_json("raw"))
    assert {"$.AVOIDED", "$.it's", "$.a b", "$.OBJECT.VOID"} <= set(paths_of_variants(df, "v"))
    got = df.select(*[F.to_json(resolve_paths(F.col("v"), [f"$.{k}"])).alias(f"c{i}") for i, k in enumerate(list(keys)[:3])]).first()
    assert list(got) == ['["x"]', '["y"]', '["z"]']


def test_malformed_documents(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id":"a"},{"id":')
    (tmp_path / "good.json").write_text('[{"id":"b"}]')
    with pytest.raises(Exception, match="Invalid JSON document .*bad.json"):
        readers.read_json_array(spark, str(tmp_path)).collect()
    assert [r["row_id"] for r in readers.read_json_array(spark, str(tmp_path), mode="DROP").collect()] == [1]
    assert [r["raw"] for r in readers.quarantine_documents(spark, str(tmp_path)).collect()] == ['[{"id":"a"},{"id":']


def test_text_keeps_source_order_and_row_id(spark, tmp_path):
    from rankloom.functions.json_text import json_text

    big = "word " * 40_000
    record = {"z": "  b   c ", "a": [1.50, True, None, {}, [], ""], "e": 'q"\\\n', "big": big, "esc": "\n" * 30_000}
    df = spark.createDataFrame([(json.dumps(record),)], "raw string")
    got = df.select(json_text(F.col("raw"))).first()[0]
    assert got == 'b c 1.5 True     q"\\ ' + big.strip() + " "
    (tmp_path / "r.jsonl").write_text('\n{"id":"a"}\n')
    assert rank_files(spark, str(tmp_path / "r.jsonl"), JobSpec(), {}).scored.first()["text"] == "a 2"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_line_numbers_do_not_move_the_text(spark, tmp_path):
    from rankloom.operators import topk

    (tmp_path / "a.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(50)))
    for df in (readers.read_jsonl(spark, str(tmp_path)), readers.read_jsonl(spark, str(tmp_path), late_ids=True)):
        moved = [part for part in df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:]]
        assert not any("raw#" in part.split("\n")[1] for part in moved)
    late = readers.read_jsonl(spark, str(tmp_path), late_ids=True)
    assert "Exchange" not in plan_of(late) and "Join" not in plan_of(late)
    best = topk.top_k(late.select(*readers.PLACE, F.try_variant_get("v", "$.n", "long").alias("n")), 3, [F.desc("n")])
    found = readers.number_lines(best, readers.line_offsets(readers.read_lines(spark, str(tmp_path))))
    assert sorted((r["n"], r["row_id"]) for r in found.collect()) == [(47, 48), (48, 49), (49, 50)]


def test_ranking_with_late_ids(spark, tmp_path):
    for name, n in (("a.jsonl", 40), ("b.jsonl", 25)):
        (tmp_path / name).write_text("".join("\n" if i % 5 == 0 else f'{{"skills": ["Grafting", "tool {i}"], "k": "{name}{i}"}}\n' for i in range(n)))
    job = JobSpec(jd_id="j", required_skills=("Grafting",))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        late = rank_files(spark, str(tmp_path), job, {}, late_ids=True, k_features=100, k_export=100)
        rows = [(r["source_file"][-7:], r["row_id"], r["candidate_id"], r["display_name"]) for r in late.ranked.collect()]
        assert sorted(rows) == sorted((f, i + 1, str(i + 1), str(i + 1)) for f, n in (("a.jsonl", 40), ("b.jsonl", 25)) for i in range(n) if i % 5)
        early = rank_files(spark, str(tmp_path), job, {}, k_features=100, k_export=100)
        ids = lambda result: sorted(r["candidate_id"] for r in result.export.collect())
        assert ids(late) == ids(early)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "c.jsonl").write_text('{"id":\n')
    with pytest.raises(Exception, match="Invalid JSONL in .*c.jsonl after byte 0"):
        rank_files(spark, str(tmp_path), job, {}, late_ids=True).ranked.collect()


def in_small_splits(spark, size, run):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        return run()
    finally:
        spark.conf.set(name, old)


def test_one_document_over_many_splits(spark, tmp_path):
    text = 'a "}{][," b \\ c\n'
    records = [{"id": i, "note": text * (i % 4), "deep": [{"candidates": [i, {"x": "}"}]}] * (i % 3)} if i % 9 else i for i in range(120)]
    for name, body in {
        "list.json": json.dumps(records, indent=1) + "\n",
        "one_line.json": json.dumps({"meta": {"k": [1, {"candidates": 5}]}, "candidates": records, "after": {"z": "]}"}}),
        "brace.json": json.dumps({"candidates": records[:40]}) + " ",
    }.items():
        path = tmp_path / name
        path.write_text(body)
        want = [(i + 1, r["id"]) for i, r in enumerate(records if name != "brace.json" else records[:40]) if isinstance(r, dict)]
        for size in (200, 3000):
            df = in_small_splits(spark, size, lambda: readers.read_json_array(spark, str(path)).select("row_id", "raw", "source_file").collect())
            assert [(r["row_id"], json.loads(r["raw"])["id"]) for r in sorted(df)] == want
            for r in df:
                assert json.loads(r["raw"]) == records[r["row_id"] - 1]


@pytest.mark.parametrize(
    "body",
    ["5", '{"candidates": {"a": 1}}', '{"candidates": null}', '[{"a": 1}', '[{"a": 1},]', '[{"a": 1}] x', '[{"a": 1}}', '{"candidates": [1], "b": }', "", '{"candidates": [1], "candidates": [2]}', '[{"a" 1}]'],
)
def test_documents_without_a_list_stop_the_job(spark, tmp_path, body):
    (tmp_path / "bad.json").write_text(body)
    with pytest.raises(Exception, match="Invalid JSON document .*bad.json"):
        readers.read_json_array(spark, str(tmp_path / "bad.json")).collect()


def test_malformed_documents_stay_out(spark, tmp_path):
    bodies = ["5", '"x"', '{"candidates": {"a": 1}}', '[{"a": 1},]', '{"candidates": [1], "b": }', "", '[{"a" 1}]', '[{"a": 1}']
    for i, body in enumerate(bodies):
        (tmp_path / f"bad{i}.json").write_text(body)
    (tmp_path / "good.json").write_text('{"candidates": [{"id": "b"}, 7, {"id": "c"}]}')
    assert ids(readers.read_json_array(spark, str(tmp_path), mode="DROP")) == [(1, "b"), (3, "c")]
    assert readers.quarantine_documents(spark, str(tmp_path)).count() == len(bodies) - 1  # an empty file has no text to list


def test_documents_without_records(spark, tmp_path):
    for i, body in enumerate(["[]", " [ ] ", "{}", '{"candidates": []}', '{"other": [{"id": 1}]}']):
        (tmp_path / f"none{i}.json").write_text(body)
    assert readers.read_json_array(spark, str(tmp_path)).count() == 0 and readers.quarantine_documents(spark, str(tmp_path)).count() == 0


def test_csv_cells_over_many_splits(spark, tmp_path):
    import csv

    rows = [[f"c{i}", i % 5 or "", f'say "{i}",\nthen\r\nx' * (i % 4), i / 4, "TRUE" if i % 2 else "false"] for i in range(150)]
    path = tmp_path / "a.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "n", "note", "x", "ok"])
        for i, r in enumerate(rows):
            out.writerow(r)
            if i % 20 == 0:
                f.write("\n")
    want = []
    for r in rows:
        row = {"id": r[0], "n": r[1], "note": r[2], "x": r[3], "ok": r[4] == "TRUE"}
        want.append({k: v for k, v in row.items() if v != ""})
    for size in (150, 2000, 10**6):
        got = in_small_splits(spark, size, lambda: readers.read_csv(spark, str(path)).collect())
        assert [json.loads(r["raw"]) for r in sorted(got, key=lambda r: r["row_id"])] == want
        assert sorted(r["row_id"] for r in got) == list(range(1, 151))
    text = readers.read_csv(spark, str(path), inferSchema=False, header=True, multiLine=True, escape='"').where("row_id = 2").first()
    assert json.loads(text["raw"]) == {"id": "c1", "n": "1", "note": rows[1][2], "x": "0.25", "ok": "TRUE"}


def test_malformed_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name\n1,a\n2,"b\n3,c\n4,d\n')
    with pytest.raises(Exception, match="Invalid CSV .*a.csv: record 2: a quote is never closed"):
        readers.read_csv(spark, str(path)).collect()
    assert ids(readers.read_csv(spark, str(path), mode="DROP")) == [(1, 1)]
    bad = readers.quarantine_csv(spark, str(path)).collect()
    assert [(r["row_id"], r["raw"]) for r in bad] == [(2, '2,"b\n3,c\n4,d\n')]
    path.write_text("id,name\n1,a\n2,b,c\n3\n")
    with pytest.raises(Exception, match="record 2: 3 cells for 2 columns"):
        readers.read_csv(spark, str(path)).collect()
    assert ids(readers.read_csv(spark, str(path), mode="DROP")) == [(1, 1), (3, 3)]
    (tmp_path / "b.csv").write_text("x;y\n")
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), sep=";").count() == 0
    (tmp_path / "c.csv").write_text("1;u\n2;v\n")
    rows = readers.read_csv(spark, str(tmp_path / "c.csv"), sep=";", header=False, schema="a double, b string").collect()
    assert [json.loads(r["raw"]) for r in sorted(rows)] == [{"a": 1.0, "b": "u"}, {"a": 2.0, "b": "v"}]
