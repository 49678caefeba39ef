"""Exact top-K that stays distributed until only K rows per group are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First-stage groups per key.  Each task sends at most K rows, and they are spread
# over this many groups before the last stage sees FAN_IN * K rows per key.
FAN_IN = 64

BY_ID = "id_asc"
BY_HEAP = "heap"


def score_order(score: str = "composite_score", row_id: str = "candidate_id", tie_break: str = BY_ID, *more: str) -> list[Column]:
    """Best score first; equal scores by id.

    ``heap`` prefers the larger id at the cut, as a bounded min-heap of
    ``(score, id)`` does; ``id_asc`` prefers the smaller id.
    """
    last = F.desc(row_id) if tie_break == BY_HEAP else F.asc(row_id)
    return [F.desc(score), last, *[F.asc(m) for m in more]]


def top_k(df: DataFrame, k: int, order: list[Column], keys: list[str] | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Best ``k`` rows per key (or overall) under a total order.

    Two ranked windows form a tree: rows are grouped by key and source task first,
    then by key.  Spark prunes every task to K rows per key before each shuffle
    (WindowGroupLimit), so neither a hot key nor a very large number of input
    partitions puts more than ``fan_in * k`` rows of a key into one final task.
    """
    keys = keys or []
    if k <= 0:
        return df.limit(0)
    spread = df.withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    first = Window.partitionBy(*keys, "_branch").orderBy(*order)
    pruned = spread.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n", "_branch")
    if not keys:
        return pruned.orderBy(*order).limit(k)
    final = Window.partitionBy(*keys).orderBy(*order)
    return pruned.withColumn("_n", F.row_number().over(final)).where(F.col("_n") <= k).drop("_n")


BINS = 1024
PASSES = 8  # each narrows the range a thousandfold; a double has no more digits than six passes


def comparable(score: Column) -> Column:
    """The score as a finite double in the same order (nulls below everything, NaN above)."""
    value = F.coalesce(F.nanvl(score.cast("double"), F.lit(1e300)), F.lit(-1e300))
    return F.greatest(F.least(value, F.lit(1e300)), F.lit(-1e300))


def cut_scores(df: DataFrame, k: int, score: str, keys: list[str]) -> list[tuple]:
    """Per key the largest score that at least ``k`` rows reach (all rows of a smaller key).

    Every pass counts rows by key and bin, combined inside the tasks, so whatever ``k``, a task sends at most
    ``BINS`` small rows per key; the bin that holds the k-th score is divided next, between the
    smallest and largest score in it.  Reads ``df`` once per pass: give it a written table.  Keys must be few
    (jobs, queries): their counts come to the driver.
    """
    n = len(keys)
    rows = df.select(*keys, comparable(F.col(score)).alias("_s"))
    spark, key_schema = df.sparkSession, T.StructType([T.StructField(c, df.schema[c].dataType) for c in keys])
    limits = T.StructType([*key_schema.fields, T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
    open_, done = {}, {}
    for r in rows.groupBy(*keys).agg(F.count("*"), F.min("_s"), F.max("_s")).collect():
        key, (count, low, high) = tuple(r[:n]), r[n:]
        (done if count <= k or low == high else open_)[key] = (low, high, 0)
    for _ in range(PASSES):
        if not open_:
            break
        bounds = spark.createDataFrame([(*key, lo, hi) for key, (lo, hi, _) in open_.items()], limits)
        inside = rows.join(F.broadcast(bounds), keys).where("_s BETWEEN _lo AND _hi")
        place = F.least(F.floor((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1))
        counted = inside.groupBy(*keys, place.alias("_bin")).agg(F.count("*"), F.min("_s"), F.max("_s")).collect()
        bins: dict[tuple, list] = {}
        for r in counted:
            bins.setdefault(tuple(r[:n]), []).append(tuple(r[n:]))
        for key, found in bins.items():
            above = open_[key][2]
            for _, count, low, high in sorted(found, reverse=True):
                if above + count >= k:
                    open_[key] = (low, high, above)
                    if above + count == k or low == high:
                        done[key] = open_.pop(key)
                    break
                above += count
    return [(*key, low) for key, (low, _, _) in {**done, **open_}.items()]


def select_k(df: DataFrame, k: int, score: str, row_id: str, keys: list[str], tie_break: str = BY_ID) -> DataFrame:
    """``top_k`` for any ``k``: the k-th score is found by counting, then only rows that reach it are shuffled and ties settled.

    Counting runs at once (see :func:`cut_scores`); the result is as lazy as any other DataFrame.
    """
    if k <= 0:
        return df.limit(0)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keys], T.StructField("_cut", T.DoubleType())])
    cuts = df.sparkSession.createDataFrame(cut_scores(df, k, score, keys), schema)
    reached = df.join(F.broadcast(cuts), keys).where(comparable(F.col(score)) >= F.col("_cut")).drop("_cut")
    return top_k(reached, k, score_order(score, row_id, tie_break), keys)


#: Runs (a key's rows in one partition) are broadcast up to this many; beyond, Spark joins them as it joins any table.
MAX_RUNS = 10_000


def rank_rows(df: DataFrame, keys: list[str], order: list[Column], path: str | None = None) -> DataFrame:
    """Add ``rank`` 1..n per key.

    Without ``path`` by one window, for shortlists, where a key has few rows.  With ``path``, a new folder that all
    executors reach, a key may have any number of rows: they are dealt by ranges of key and order, sorted and numbered
    there, and written at once; a row's rank is its place in its partition plus the counts of the key's partitions before.
    Rows equal in key and order are dealt out too.  Reads ``df`` twice (once to find the ranges): give it a written table.
    """
    if path is None:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    spark, by = df.sparkSession, [*keys, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = dealt.drop("_tie").withColumn("_row", F.monotonically_increasing_id())  # partition in the upper bits, place in the lower 33
    dealt.write.parquet(f"{path}/rows")
    rows = spark.read.schema(dealt.schema).parquet(f"{path}/rows").withColumn("_part", F.shiftright("_row", 33))
    named = {c: f"_key{i}" for i, c in enumerate(keys)}
    runs = rows.groupBy(*[F.col(c).alias(n) for c, n in named.items()], F.col("_part").alias("_of")).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    )
    before = Window.partitionBy(*named.values()).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    runs = runs.select(*named.values(), "_of", shift.alias("_shift"))
    runs.write.parquet(f"{path}/runs")
    runs = spark.read.schema(runs.schema).parquet(f"{path}/runs")
    runs = F.broadcast(runs) if runs.count() <= MAX_RUNS else runs
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    ranked = rows.join(runs, [F.col("_part") == F.col("_of"), *same])
    return ranked.select(*df.columns, (F.col("_row") + F.col("_shift")).cast("int").alias("rank"))


def normalised_score(df: DataFrame, keys: list[str], score: str = "composite_score") -> DataFrame:
    """Add ``norm_score`` in [0.1, 1.0] by min-max over the shortlisted rows of a key."""
    group = Window.partitionBy(*keys)
    low, high = F.min(score).over(group), F.max(score).over(group)
    df = df.withColumn("_low", low).withColumn("_high", high)
    scaled = 0.1 + 0.9 * ((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.withColumn(
        "norm_score", F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(scaled)
    ).drop("_low", "_high")


def format_score(score: Column) -> Column:
    return F.format_string("%.8f", score)
