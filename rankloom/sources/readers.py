"""Record sources.  Every reader gives raw JSON text plus a row id, unparsed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.json_text import is_json
from rankloom.jobs import JOB_SCHEMA
from rankloom.operators.profile import parse_records
from rankloom.sources import csv_records, json_documents

BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def is_object(raw: Column) -> Column:
    """Valid JSON that starts with a brace is an object."""
    return raw.rlike(r"^\s*\{")


#: Tables of one row per split are broadcast up to this many scan tasks (a task packs at most some
#: 33 splits, so they stay within a few MB); beyond, Spark joins them as it joins any table.
MAX_LOOKUP_TASKS = 4096
PLACE = ("source_file", "split_start", "split_row")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their place: ``raw, source_file, split_start, split_row``.

    ``split_row`` counts lines inside one task in file order.  The three columns of ``PLACE`` identify a
    line without any shuffle and order a file's lines; ``number_lines`` turns them into a line
    number wherever one is wanted, be it on the few rows of a shortlist.
    """
    return spark.read.text(path).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("split_row"),
    )


def line_offsets(lines: DataFrame) -> DataFrame:
    """One row per split: its lines ``n``, the lines of its file before it (``line_offset``), and ``first_row``.

    Counted inside the scan tasks; only these rows, never lines, are shuffled and ordered.
    """
    splits = lines.groupBy("source_file", "split_start").agg(F.min("split_row").alias("first_row"), F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("line_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def number_lines(rows: DataFrame, offsets: DataFrame, column: str = "row_id") -> DataFrame:
    """Physical 1-based line numbers (blank lines included) for rows that carry their place.

    ``rows`` may be any rows derived from the lines that ``offsets`` counts: a shortlist, quarantined
    lines, or all of them.
    """
    shift = offsets.select("source_file", "split_start", (F.col("line_offset") - F.col("first_row") + 1).alias("_shift"))
    numbered = rows.join(shift, ["source_file", "split_start"])
    return numbered.select(*[c for c in rows.columns if c != column], (F.col("split_row") + F.col("_shift")).alias(column))


def lookup(offsets: DataFrame, scan: DataFrame) -> DataFrame:
    """``offsets`` marked for broadcast if the tasks of the scan bound their number."""
    return F.broadcast(offsets) if scan.rdd.getNumPartitions() <= MAX_LOOKUP_TASKS else offsets


def with_line_numbers(lines: DataFrame, column: str = "row_id", accepted: Column | None = None) -> DataFrame:
    """Every line with its number, looked up in the table of splits: the text itself is not moved.

    With ``accepted`` only accepted lines are counted and returned, which gives dense
    ids; ``lines`` must then come straight from the scan.  Inputs of more than
    ``MAX_LOOKUP_TASKS`` tasks are better numbered late, see ``number_lines``.
    """
    if accepted is not None:
        lines = (
            lines.withColumn("_ok", F.coalesce(accepted, F.lit(False)))
            .where("_ok")
            .drop("_ok")
            .withColumn("split_row", F.monotonically_increasing_id())
        )
    return number_lines(lines, lookup(line_offsets(lines), lines), column)


def spread_unsplittable(df: DataFrame, path: str | list[str]) -> DataFrame:
    """A gzip file is one split: deal its rows to all cores before the heavy work.

    Decided by the names of the files that the scan found, so folders and globs count too.
    """
    if any(p.lower().endswith(".gz") for p in df.inputFiles()):
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Deal rows to all cores when the scan has fewer splits than the cluster has cores.

    A large table has far more splits than cores and passes through unchanged; a few
    small files would otherwise leave the scoring stage to a few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_jsonl(
    spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST", dense_ids: bool = False, late_ids: bool = False
) -> DataFrame:
    """JSON objects of line-delimited files: ``row_id, source_file, raw, v``.

    Blank lines and lines that are valid JSON but not an object are skipped.  A
    malformed line stops the job with its line number (``FAILFAST``) or is left out
    and shown by ``quarantine`` (``DROP``).  ``dense_ids`` numbers accepted records
    1..n instead of using the physical line number.  ``late_ids`` gives the place of a line
    (``split_start, split_row``) instead of its number: one scan, nothing counted or joined.
    """
    blank = F.col("raw").rlike(BLANK)
    lines = read_lines(spark, path)
    if dense_ids or late_ids:
        # numbered inside the scan stage, before any shuffle can change the row order
        place = F.concat(F.lit("in "), F.col("source_file"), F.lit(" after byte "), F.col("split_start").cast("string"))
    else:
        lines = with_line_numbers(lines)
        place = F.concat(F.lit("on line "), F.col("row_id").cast("string"))
    bad = F.raise_error(F.concat(F.lit("Invalid JSONL "), place)) if mode == "FAILFAST" else F.lit(False)
    accepted = F.when(blank, F.lit(False)).when(~is_json(F.col("raw")), bad).otherwise(is_object(F.col("raw")))
    if dense_ids:
        records = spread_unsplittable(with_line_numbers(lines, accepted=accepted), path)
    else:
        records = spread_unsplittable(lines, path).where(accepted)
    return parse_records(records).select(*(PLACE[1:] if late_ids else ["row_id"]), "source_file", "raw", "v")


def quarantine(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Malformed lines with file and line number, for repair; only these lines are joined with the counts.

    Besides broken text this holds what the strict parser refuses: duplicate keys,
    ``NaN`` and ``Infinity``.
    """
    lines = read_lines(spark, path)
    bad = lines.where(~F.col("raw").rlike(BLANK) & ~is_json(F.col("raw")))
    return number_lines(bad, line_offsets(lines)).select("source_file", "row_id", "raw")


def quarantine_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON documents (file and text) that are malformed, or hold no list where one belongs, for repair."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))
    parsed = F.try_parse_json("raw")
    listed = F.try_variant_get(parsed, "$.candidates", "variant").isNull() | F.try_variant_get(parsed, "$.candidates", "array<variant>").isNotNull()
    good = is_json(F.col("raw")) & (F.col("raw").rlike(r"^\s*\[") | (is_object(F.col("raw")) & listed))
    return docs.where(~good)


def read_json_array(spark: SparkSession, path: str | list[str], *, mode: str = "FAILFAST") -> DataFrame:
    """Records of JSON documents: a top-level list, or the list under ``candidates``.

    Large documents are read split by split on all cores (see ``json_documents``).  A document that is malformed
    or holds no such list stops the job with its name (``FAILFAST``) or stays out (``DROP``, see
    ``quarantine_documents``); an object without ``candidates`` has no records.

    Each element keeps its own raw text in source order; the row id is its 1-based
    position in the list, counted before other elements are dropped.
    """
    listed = json_documents.read_elements(spark, path, mode)
    return parse_records(listed.where(is_object(F.col("raw"))).select("row_id", "source_file", "raw"))


def csv_table(
    spark: SparkSession, path: str | list[str], *, header: bool = True, sep: str = ",", quote: str = '"'
) -> tuple[DataFrame, list[str]]:
    """Parsed CSV records with their ``fault`` (null if none), and the column names; the header is no record."""
    records, unclosed = csv_records.read_records(spark, path, sep, quote)
    first = records.where("record = 0").select("source_file", "cells").collect()  # one row per file
    names = {tuple(r.cells) for r in first}
    if header and len(names) > 1:
        raise ValueError("CSV files of one table must have the same header")
    cells = next(iter(names), ()) if header else [None] * max((len(r.cells) for r in first), default=0)
    columns = [c or f"_c{i}" for i, c in enumerate(cells)]
    rows = records.where("record > 0") if header else records.withColumn("record", F.col("record") + 1)
    unclosed = {f: n + (not header) for f, n in unclosed.items()}
    return rows.withColumn("fault", csv_records.faults(rows, len(columns), unclosed)), columns


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    mode: str = "FAILFAST",
    schema: str | T.StructType | None = None,
    header: bool = True,
    inferSchema: bool = True,  # noqa: N803  (the names of Spark's own options)
    sep: str = ",",
    quote: str = '"',
    multiLine: bool = True,  # noqa: N803
    escape: str = '"',
) -> DataFrame:
    """Records of CSV files: ``source_file, row_id, raw``; types inferred, empty cells null, rows short of cells filled with nulls.

    Cells may hold line breaks; files are still cut in parallel (see ``csv_records``).  A record of too many
    cells, or one whose quote is never closed, stops the job with its file and record number
    (``FAILFAST``) or stays out (``DROP``, see ``quarantine_csv``).  ``schema`` gives names and types,
    ``inferSchema=False`` leaves all cells texts; row ids count the records of a file from 1.
    """
    if escape != quote or not multiLine:
        raise ValueError("quotes are escaped by doubling them, and cells may always hold line breaks")
    rows, columns = csv_table(spark, path, header=header, sep=sep, quote=quote)
    good = rows.where("fault IS NULL")
    if schema is not None:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        columns, types = given.names, [f.dataType.simpleString() for f in given.fields]
    else:
        types = csv_records.column_types(good, len(columns)) if inferSchema else ["string"] * len(columns)
    cell = lambda i, t: F.get("cells", F.lit(i)) if t == "string" else F.trim(F.get("cells", F.lit(i))).try_cast(t)
    record = F.to_json(F.struct(*[cell(i, t).alias(c) for i, (c, t) in enumerate(zip(columns, types))])) if columns else F.lit("{}")
    if mode == "FAILFAST":
        place = F.concat(F.lit("Invalid CSV "), F.col("source_file"), F.lit(": record "), F.col("record").cast("string"), F.lit(": "), F.col("fault"))
        record, good = F.when(F.col("fault").isNull(), record).otherwise(F.raise_error(place)), rows
    return good.select("source_file", F.col("record").alias("row_id"), record.alias("raw"))


def quarantine_csv(spark: SparkSession, path: str | list[str], *, header: bool = True, sep: str = ",", quote: str = '"') -> DataFrame:
    """Malformed CSV records with file, record number, text and reason, for repair."""
    rows, _ = csv_table(spark, path, header=header, sep=sep, quote=quote)
    return rows.where("fault IS NOT NULL").select("source_file", F.col("record").alias("row_id"), "raw", "fault")


def number_rows(df: DataFrame, column: str = "row_id") -> DataFrame:
    """Dense 1..n over the rows of a table in task order, without sorting or moving them.

    One count per task is summed up and looked up again; the counting pass reads no column.
    """
    tagged = df.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    tasks = tagged.groupBy("_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return tagged.join(lookup(shift, df), "_task").select(*df.columns, (F.col("_row") + F.col("_shift")).alias(column))


def read_job_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Job texts from TXT or Markdown files, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_jobs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Structured job descriptions, one JSON document per file, defaults filled in."""
    docs = spark.read.text(path, wholetext=True)
    job = F.from_json("value", JOB_SCHEMA, {"mode": "FAILFAST"})
    parsed = docs.select(F.col("_metadata.file_name").alias("file"), job.alias("j"))
    return parsed.select(*[_default(f).alias(f.name) for f in JOB_SCHEMA])


def _default(field) -> Column:
    value = F.col("j")[field.name]
    if field.name == "jd_id":
        return F.coalesce(value, F.col("file"))
    if field.name == "experience_years_min":
        return value
    empty = F.lit("") if field.dataType.simpleString() == "string" else F.array().cast("array<string>")
    return F.coalesce(value, empty)


def read_schema(spark: SparkSession, path: str) -> dict:
    """A record schema document; it must be a JSON object that describes an object."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    doc = json.loads(text)
    if not isinstance(doc, dict) or doc.get("type") not in (None, "object"):
        raise ValueError("a record schema must describe an object")
    return doc


def valid_schema_documents(df: DataFrame, column: str = "raw") -> DataFrame:
    """Mark the schema documents of a table that are usable."""
    v = F.try_parse_json(column)
    kind = F.try_variant_get(v, "$.type", "string")
    good = v.isNotNull() & is_object(F.col(column)) & (kind.isNull() | (kind == "object"))
    return df.withColumn("is_valid", F.coalesce(good, F.lit(False)))
