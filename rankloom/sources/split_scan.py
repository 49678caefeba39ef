"""Records that span many lines or splits, cut by prefix scans over the splits.

A file is read by Spark as fragments between separators, split by split.  What a fragment means
depends on all text before it (inside a string or not, how deep), so a first pass sums up every split
for each state it may begin in, the summaries are chained in file order, and a second pass cuts records
with every split's true start state known.  Only a record that crosses a split boundary is put
together after a shuffle; everything else stays where it was read.

The chain holds one small entry per split, like the list of files that the driver keeps for any scan.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# the functions of this module travel with the plan, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 2000


def fragments(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """Text between separators in file order: ``source_file, split_start, file_size, raw``."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").cast("binary").alias("raw"),
    )


def per_split(df: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Walk every split in order: ``start(file, split_start, file_size)`` gives an object whose ``feed(fragments)``
    and ``end()`` return rows (or None, for a split to leave out)."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def runs(batches):
        key, walk = None, None
        for batch in batches:
            files, starts, sizes, raws = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(files):
                here, stop = (files[at], starts[at]), at + 1
                while stop < len(files) and starts[stop] == here[1] and files[stop] == here[0]:
                    stop += 1
                if here != key:
                    if walk is not None:
                        yield from walk.end()
                    key, walk = here, start(*here, sizes[at])
                if walk is not None:
                    yield from walk.feed(raws[at:stop])
                at = stop
        if walk is not None:
            yield from walk.end()

    def run(batches):
        out = []
        for row in runs(batches):
            out.append(row)
            if len(out) == ROWS:
                yield batch_of(out, target)
                out = []
        if out:
            yield batch_of(out, target)

    return df.mapInArrow(run, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def by_file(rows: Iterable) -> dict[str, list]:
    """Summaries of splits, grouped by file and in file order."""
    files: dict[str, list] = {}
    for row in rows:
        files.setdefault(row["source_file"], []).append(row)
    return {name: sorted(splits, key=lambda r: r["split_start"]) for name, splits in files.items()}


PIECES = "source_file string, record long, split_start long, part int, whole boolean, raw binary"


def whole_records(pieces: DataFrame) -> DataFrame:
    """``source_file, record, raw``: pieces of records that cross splits are joined, the others pass by."""
    parts = pieces.where(~F.col("whole")).groupBy("source_file", "record").agg(F.sort_array(F.collect_list(F.struct("split_start", "part", "raw"))).alias("p"))
    joined = parts.select("source_file", "record", F.array_join(F.transform("p", lambda p: p["raw"].cast("string")), "").alias("raw"))
    return pieces.where("whole").select("source_file", "record", F.col("raw").cast("string").alias("raw")).unionByName(joined)
