"""Score arriving JSONL files and keep a running shortlist."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom import constants as C
from rankloom.functions.json_text import is_json
from rankloom.jobs import JobSpec
from rankloom.operators import features, topk
from rankloom.operators.profile import DEFAULT_SIGNALS_FIELD, parse_records, profiles_from_json
from rankloom.operators.schema_map import SchemaMap
from rankloom.plans.ranking import CARRIED, score_all
from rankloom.sources.readers import BLANK, is_object, spread_small_scan

#: Mark of lines that are one JSON value.
SOUND = "_sound"


def arriving_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of text files appearing under a folder, as a stream: ``raw, source_file``."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(path)
        .select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"))
    )


def sound_records(lines: DataFrame) -> DataFrame:
    """Parsed JSON objects among lines; blank lines, other JSON values and malformed lines stay out."""
    parsed = parse_records(lines.where(~F.col("raw").rlike(BLANK) & is_object(F.col("raw"))))
    return parsed.where(F.col("v").isNotNull() & _is_sound(lines))


def _is_sound(lines: DataFrame) -> Column:
    """Whether a line is one JSON value, as ``rank_arrivals`` has found it out before."""
    return F.col(SOUND) if SOUND in lines.columns else is_json(F.col("raw"))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor one JSON value: what the batch reader's quarantine lists."""
    return lines.where(~F.col("raw").rlike(BLANK) & ~_is_sound(lines))


def arriving_records(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Records of JSONL files appearing under a folder.

    Malformed lines are skipped: one bad line must not stop a stream.  ``rank_arrivals`` writes them to a
    table of their own; the batch reader's quarantine lists them with line numbers.
    """
    return sound_records(arriving_lines(spark, path, max_files))


def stream_scores(
    records: DataFrame,
    jobs: list[JobSpec],
    schema_map: SchemaMap,
    signals_field: str = DEFAULT_SIGNALS_FIELD,
) -> DataFrame:
    """The batch scoring columns on a stream; stateless, so no watermark is needed."""
    profiles = profiles_from_json(records, schema_map, keep=("source_file",), signals_field=signals_field)
    return score_all(profiles, jobs)


def current_shortlist(spark: SparkSession, state: str) -> DataFrame | None:
    """Newest stored shortlist, or None before the first batch."""
    newest = _newest(spark, state, before=None)
    return None if newest is None else spark.read.parquet(f"{state}/batch={newest}")


def _batches(spark: SparkSession, state: str) -> list[tuple[int, bool]]:
    """Batch folders and whether each is complete; listed through Hadoop, so any shared store works."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("batch="):
            done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            found.append((int(name.removeprefix("batch=")), fs.exists(done)))
    return found


def _newest(spark: SparkSession, state: str, before: int | None) -> int | None:
    """Largest complete batch folder."""
    found = [n for n, complete in _batches(spark, state) if complete]
    return max((n for n in found if before is None or n < before), default=None)


#: Stored shortlists that stay.  A restart replays at most the last batch, which needs the one before it.
KEEP_BATCHES = 3


def _remove_old(spark: SparkSession, state: str, keep: int) -> None:
    """Delete all but the newest ``keep`` complete shortlists; unfinished older folders go with them."""
    done = sorted((n for n, complete in _batches(spark, state) if complete), reverse=True)[:keep]
    if len(done) < keep:
        return
    root = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for n, _ in _batches(spark, state):
        if n < done[-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"batch={n}"), True)


def _merge(batch: DataFrame, batch_id: int, state: str, k: int, tie_break: str, keep: int) -> None:
    """Best rows of one batch and of the newest older shortlist, written as ``batch=<id>``."""
    spark = batch.sparkSession
    order = topk.score_order("composite_score", "candidate_id", tie_break, "source_file")
    rows = topk.top_k(batch.select("source_file", *CARRIED), k, order, ["jd_id"])
    newest = _newest(spark, state, before=batch_id)
    if newest is not None:
        rows = rows.unionByName(spark.read.parquet(f"{state}/batch={newest}"))
        rows = topk.top_k(rows, k, order, ["jd_id"])
    rows.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
    _remove_old(spark, state, keep)


def _started(stream: DataFrame, write, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def keep_running_topk(
    scores: DataFrame,
    state: str,
    checkpoint: str,
    k: int = C.TOP_K_FEATURES,
    tie_break: str = topk.BY_ID,
    *,
    trigger: dict | None = None,
    keep_batches: int = KEEP_BATCHES,
) -> StreamingQuery:
    """Merge every batch into a stored shortlist of ``k`` rows per job.

    Batch ``n`` reads the newest shortlist older than ``n`` and writes ``batch=n``, so a
    replayed batch gives the same files again; only the newest ``keep_batches`` (2 or more) stay.  ``state`` and ``checkpoint`` must be
    folders that every executor can reach.  ``trigger`` is what ``DataStreamWriter.trigger`` takes, such as
    ``{"processingTime": "30 seconds"}`` for a stream that goes on; by default it ends when all files are read.
    """
    check_kept(keep_batches)
    return _started(scores, lambda batch, n: _merge(batch, n, state, k, tie_break, keep_batches), checkpoint, trigger)


def check_kept(keep_batches: int) -> None:
    if keep_batches < 2:
        raise ValueError("a replayed batch needs the shortlist before it: keep 2 batches or more")


def rank_arrivals(
    spark: SparkSession,
    path: str,
    jobs: list[JobSpec],
    schema_map: SchemaMap,
    state: str,
    checkpoint: str,
    *,
    rejects: str | None = None,
    k: int = C.TOP_K_FEATURES,
    tie_break: str = topk.BY_ID,
    signals_field: str = DEFAULT_SIGNALS_FIELD,
    max_files: int = 1000,
    trigger: dict | None = None,
    keep_batches: int = KEEP_BATCHES,
) -> StreamingQuery:
    """Running shortlist over arriving JSONL files, with a side table of malformed lines.

    Each batch appends its malformed lines to ``rejects`` (Parquet, ``raw, source_file, batch``; read it with ``rejected_lines``)
    as its own partition, which a replay replaces, before it merges its sound records into the shortlist as
    ``keep_running_topk`` does.  The lines of a batch are kept on the executors' disks meanwhile, so files are read once.
    """
    check_kept(keep_batches)

    def write(batch: DataFrame, batch_id: int) -> None:
        if rejects is None:
            ranked(spread_small_scan(batch), batch_id)
            return
        # a batch of a few files must not leave the scoring to a few tasks; every line is looked at once for both tables
        batch = spread_small_scan(batch).withColumn(SOUND, is_json(F.col("raw"))).persist(StorageLevel.DISK_ONLY)
        try:
            bad = malformed_lines(batch).drop(SOUND).withColumn("batch", F.lit(batch_id).cast("long"))
            bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects)
            ranked(batch, batch_id)
        finally:
            batch.unpersist()

    def ranked(batch: DataFrame, batch_id: int) -> None:
        scores = stream_scores(sound_records(batch), jobs, schema_map, signals_field)
        _merge(scores, batch_id, state, k, tie_break, keep_batches)

    return _started(arriving_lines(spark, path, max_files), write, checkpoint, trigger)


def rejected_lines(spark: SparkSession, rejects: str) -> DataFrame:
    """Malformed lines met so far: ``raw, source_file, batch``; empty if there were none."""
    return spark.read.schema("raw string, source_file string, batch long").parquet(rejects)


def shortlist_details(shortlist: DataFrame) -> DataFrame:
    """Breakdown, strengths and concerns for a stored shortlist."""
    return features.add_details(shortlist)
