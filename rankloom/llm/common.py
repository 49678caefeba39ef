"""Shared pieces: reading tables, Arrow batches of whole texts, tables in the shared folder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import shared_dir

#: White space of the word definitions used throughout: `[^\x20\x09-\x0D]+` is a word.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

#: Bytes and rows of one Arrow batch: some long texts must not meet in one batch.
BATCH_BYTES = "8m"
BATCH_ROWS = "2000"


def by_value(name: str) -> None:
    """Ship a module's functions with the tasks, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts need no more memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def utf8(column: str = "text"):
    """The column's bytes; null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, function: Callable[[Iterator], Iterable[tuple]], schema: str, rows: int = 4000) -> DataFrame:
    """``function`` turns an iterator of column lists into rows; rows go out in bounded batches."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        lists = (tuple(c.to_pylist() for c in b.columns) for b in batches)
        out = []
        for row in function(lists):
            out.append(row)
            if len(out) >= rows:
                yield to_batch(out, target)
                out = []
        if out:
            yield to_batch(out, target)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def span_text(spans: list[tuple[int, int, str, int]]) -> str:
    """`kind:start:end` of (start, order of kind, kind, end), sorted and comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
