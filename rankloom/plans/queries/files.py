"""Queries for readers, writers and streams, over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.functions.json_text import json_text
from rankloom.jobs import JOB_SCHEMA
from rankloom.operators import reports, topk
from rankloom.plans import oracle as O

from rankloom.plans.fixtures import CANDIDATE_JOBS
from rankloom.plans.queries.registry import (
    candidates,
    candidates_json,
    documents_scored,
    query,
    schema_map,
    scratch,
    table,
)
from rankloom.plans.ranking import keep_best
from rankloom.sources import readers
from rankloom.sources.writers import write_frame_jobs, write_ranked_csv
from rankloom.streaming import arrivals

_TEXTS = O.on_candidates("SELECT candidate_id, length(text) AS n_chars FROM prof", "prof")


def _records(df):
    cid = F.try_variant_get("v", "$.candidate_id", "string")
    return df.select(cid.alias("candidate_id"), F.length(json_text(F.col("raw"))).alias("n_chars"))


def _write_lines(spark, sf, name: str, **options) -> str:
    path = scratch(spark, name)
    candidates_json(spark, sf).select("raw").write.text(path, **options)
    return path


@query("scan_jsonl", _TEXTS)
def _(spark, sf):
    return _records(readers.read_jsonl(spark, _write_lines(spark, sf, "jsonl")))


@query("scan_jsonl_gz", _TEXTS)
def _(spark, sf):
    return _records(readers.read_jsonl(spark, _write_lines(spark, sf, "jsonl", compression="gzip") + "/*.gz"))


@query("scan_json_array", _TEXTS)
def _(spark, sf):
    """Documents of up to 500 records each, half of them wrapped in an object."""
    path = scratch(spark, "arrays")
    part = F.floor(F.col("key") / 500).alias("part")
    lists = candidates_json(spark, sf).groupBy(part).agg(F.array_join(F.collect_list("raw"), ",\n").alias("body"))
    plain = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    wrapped = F.concat(F.lit('{"candidates": '), plain, F.lit("}"))
    text = F.when(F.col("part") % 2 == 0, plain).otherwise(wrapped).alias("value")
    lists.select("part", text).write.partitionBy("part").text(path)
    return _records(readers.read_json_array(spark, f"{path}/*"))


@query(
    "scan_csv",
    O.on_candidates(
        "SELECT candidate_id || ' ' || title || ' ' || CAST(coalesce(profile_years, 0) AS VARCHAR) AS text, length(summary) AS n_summary FROM cand", "cand"
    ),
)
def _(spark, sf):
    path = scratch(spark, "csv")
    rows = candidates(spark, sf).select(
        "candidate_id",
        F.col("profile.current_title").alias("title"),
        F.coalesce("profile.years_of_experience", F.lit(0.0)).alias("years"),
        F.concat(F.lit('say "'), F.col("summary"), F.lit('",\nthen')).alias("note"),
    )
    rows.write.csv(path, header=True, escape='"')
    found = readers.read_csv(spark, path)
    note = F.get_json_object("raw", "$.note")
    short = F.to_json(F.from_json("raw", "candidate_id string, title string, years double"))
    return found.select(json_text(short).alias("text"), (F.length(note) - 12).alias("n_summary"))


def _nation_lines(spark, sf) -> str:
    """One file per nation with a line per customer in key order; every tenth line is blank, every seventh broken."""
    path = scratch(spark, "lines")
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    good = F.to_json(F.struct("c_custkey", "c_acctbal"))
    line = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).when(F.col("c_custkey") % 7 == 0, F.lit('{"c_custkey": ')).otherwise(good)
    dealt = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    dealt.select(F.col("c_nationkey").alias("nation"), line.alias("value")).write.partitionBy("nation").text(path)
    return path


def _nation(df):
    return df.withColumn("nation", F.regexp_extract("source_file", r"nation=(\d+)", 1).cast("int"))


def _cut_fine(spark, plan):
    """Run ``plan`` over splits of 2 KB, so that files have many, and give its rows."""
    name = "spark.sql.files.maxPartitionBytes"
    before, out = spark.conf.get(name), scratch(spark, "rows")
    spark.conf.set(name, "2048")
    try:
        plan().write.parquet(out)
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out)


_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, c_custkey % 10 = 0 AS blank, c_custkey % 10 <> 0 AND c_custkey % 7 = 0 AS broken FROM customer)"


@query("row_id_line", f"WITH {_LINES} SELECT c_nationkey AS nation, c_custkey AS key, line AS row_id FROM l WHERE NOT blank AND NOT broken")
def _(spark, sf):
    path = _nation_lines(spark, sf)
    key = F.try_variant_get("v", "$.c_custkey", "long").alias("key")
    return _cut_fine(spark, lambda: _nation(readers.read_jsonl(spark, path, mode="DROP")).select("nation", key, "row_id"))


@query(
    "line_offset",
    f"""WITH {_LINES}, best AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, line) AS place FROM l WHERE NOT blank AND NOT broken)
SELECT c_nationkey AS nation, c_custkey AS key, line AS row_id, n AS n_lines FROM best JOIN (SELECT c_nationkey, count(*) AS n FROM l GROUP BY c_nationkey) USING (c_nationkey) WHERE place <= 3""",
)
def _(spark, sf):
    """Line numbers for a shortlist only: places go through the cut, the counts of splits join what is left."""
    path = _nation_lines(spark, sf)

    def plan():
        records = _nation(readers.read_jsonl(spark, path, mode="DROP", late_ids=True))
        rows = records.select(
            "nation", *readers.PLACE, F.try_variant_get("v", "$.c_custkey", "long").alias("key"), F.try_variant_get("v", "$.c_acctbal", "double").alias("score")
        )
        best = topk.top_k(rows, 3, [F.desc("score"), F.asc("split_start"), F.asc("split_row")], ["nation"])
        offsets = readers.line_offsets(readers.read_lines(spark, path))
        totals = _nation(offsets).groupBy("nation").agg(F.max(F.col("line_offset") + F.col("n")).alias("n_lines"))
        return readers.number_lines(best, offsets).join(totals, "nation").select("nation", "key", "row_id", "n_lines")

    return _cut_fine(spark, plan)


@query(
    "row_id_dense",
    f"WITH {_LINES} SELECT c_nationkey AS nation, c_custkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY line) AS row_id FROM l WHERE NOT blank AND NOT broken",
)
def _(spark, sf):
    path = _nation_lines(spark, sf)
    key = F.try_variant_get("v", "$.c_custkey", "long").alias("key")
    return _cut_fine(spark, lambda: _nation(readers.read_jsonl(spark, path, mode="DROP", dense_ids=True)).select("nation", key, "row_id"))


@query("bad_record_policy", f"WITH {_LINES} SELECT c_nationkey AS nation, line AS row_id, broken AS is_bad FROM l WHERE NOT blank")
def _(spark, sf):
    path = _nation_lines(spark, sf)

    def plan():
        good = readers.read_jsonl(spark, path, mode="DROP").select("source_file", "row_id", F.lit(False).alias("is_bad"))
        bad = readers.quarantine(spark, path).select("source_file", "row_id", F.lit(True).alias("is_bad"))
        return _nation(good.unionByName(bad)).select("nation", "row_id", "is_bad")

    return _cut_fine(spark, plan)


@query("scan_job_text", "SELECT item_id, md5(text) AS digest FROM benchmark")
def _(spark, sf):
    path = scratch(spark, "jobs")
    table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text").write.partitionBy("item").text(path)
    rows = readers.read_job_texts(spark, f"{path}/*")
    item = F.regexp_extract("path", r"item=(\d+)", 1).cast("long")
    return rows.select(item.alias("item_id"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"))


def _brand_jobs(spark, sf):
    """One structured job per part brand; a brand has at most 64 different part names."""
    names = F.array_sort(F.collect_set("p_name"))
    jobs = table(spark, sf, "part").groupBy(F.col("p_brand").alias("jd_id")).agg(names.alias("required_skills"))
    known = set(jobs.columns)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in JOB_SCHEMA if f.name not in known]
    return jobs.select("*", *rest).select(*JOB_SCHEMA.names)


_BRANDS = """SELECT p_brand AS jd_id, count(DISTINCT p_name) AS n_required, array_to_string(list_slice(list_sort(list(DISTINCT p_name)), 1, 3), '|') AS first_three,
  '' AS title, 0 AS n_preferred FROM part GROUP BY p_brand"""


@query("load_jd", _BRANDS)
def _(spark, sf):
    path = scratch(spark, "jd")
    write_frame_jobs(_brand_jobs(spark, sf), path)
    jobs = readers.read_jobs(spark, path)
    return jobs.select(
        "jd_id",
        F.size("required_skills").cast("long").alias("n_required"),
        F.array_join(F.slice("required_skills", 1, 3), "|").alias("first_three"),
        "title",
        F.size("preferred_skills").alias("n_preferred"),
    )


@query("sink_jd_cache", "SELECT count(DISTINCT p_brand) AS n_jobs, count(DISTINCT p_brand) AS n_files FROM part")
def _(spark, sf):
    path = scratch(spark, "jd")
    write_frame_jobs(_brand_jobs(spark, sf), path)
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"))
    return rows.agg(F.count_if(F.try_parse_json("value").isNotNull()).alias("n_jobs"), F.count_distinct("f").alias("n_files"))


@query(
    "sink_ranked_csv",
    O.on_documents("SELECT candidate_id, CAST(rank AS INTEGER) AS rank, fallback_reason AS reasoning FROM rs WHERE rank <= 100"),
)
def _(spark, sf):
    path = scratch(spark, "export")
    write_ranked_csv(reports.export_rows(keep_best(documents_scored(spark, sf), C.TOP_K_FEATURES)), path)
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select("candidate_id", F.col("rank").cast("int").alias("rank"), "reasoning")


def _arriving(spark, sf):
    path = _write_lines(spark, sf, "arriving")
    records = arrivals.arriving_records(spark, path, max_files=4)
    return arrivals.stream_scores(records, CANDIDATE_JOBS, schema_map(spark, sf))


@query(
    "stream_score",
    O.on_candidates("SELECT jd_id, candidate_id, composite_score FROM scored", "scored"),
)
def _(spark, sf):
    out, state = scratch(spark, "scores"), scratch(spark, "checkpoint")
    scores = _arriving(spark, sf).select("jd_id", "candidate_id", "composite_score")
    stream = scores.writeStream.format("parquet").option("checkpointLocation", state)
    stream.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_topk",
    O.on_candidates(
        "SELECT jd_id, candidate_id, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY composite_score DESC, candidate_id) AS place FROM scored) WHERE place <= 50",
        "scored",
    ),
)
def _(spark, sf):
    state, checkpoint = scratch(spark, "shortlist"), scratch(spark, "checkpoint")
    arrivals.keep_running_topk(_arriving(spark, sf), state, checkpoint, k=50).awaitTermination()
    return arrivals.current_shortlist(spark, state).select("jd_id", "candidate_id", "composite_score")


def _damaged(spark, sf):
    """JSONL files in which the records of every tenth candidate lack their last character."""
    path = scratch(spark, "damaged")
    ends = F.endswith(F.get_json_object("raw", "$.candidate_id"), F.lit("3"))
    raw = F.when(ends, F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw"))
    candidates_json(spark, sf).select(raw.alias("value")).write.text(path)
    return path


def _rank_damaged(spark, sf) -> tuple[str, str]:
    state, rejects = scratch(spark, "shortlist"), scratch(spark, "rejects")
    jobs, paths = CANDIDATE_JOBS, schema_map(spark, sf)
    options = {"rejects": rejects, "k": 50, "max_files": 4}
    arrivals.rank_arrivals(spark, _damaged(spark, sf), jobs, paths, state, scratch(spark, "checkpoint"), **options).awaitTermination()
    return state, rejects


@query(
    "stream_rejects",
    O.on_candidates("SELECT candidate_id FROM cand WHERE candidate_id LIKE '%3'", "cand"),
)
def _(spark, sf):
    """Malformed lines of a stream, from the side table."""
    lines = arrivals.rejected_lines(spark, _rank_damaged(spark, sf)[1])
    return lines.select(F.regexp_extract("raw", '"candidate_id":"([^"]*)"', 1).alias("candidate_id"))


@query(
    "stream_shortlist",
    O.on_candidates(
        "SELECT jd_id, candidate_id, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY composite_score DESC, candidate_id) AS place FROM scored WHERE candidate_id NOT LIKE '%3') WHERE place <= 50",
        "scored",
    ),
)
def _(spark, sf):
    """The shortlist of the same stream's sound lines."""
    return arrivals.current_shortlist(spark, _rank_damaged(spark, sf)[0]).select("jd_id", "candidate_id", "composite_score")
