"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source whose target exceeds its size is first repeated in complete epochs; the rest of
the target is a weighted sample without replacement: documents are put in the order of
their exponential keys ``-ln(u) / weight`` and taken while the prefix sum of their words
stays within the budget.  The document at the budget's edge is taken in part.

Prefix sums never gather a source in one task: keys fall into bins of a logarithmic grid,
``BINS_PER_OCTAVE`` to a factor of two, so that no bin holds more than about a thousandth of
a source, whatever the weights (a key lies in one bin with probability of at most
``2 ** (1 / BINS_PER_OCTAVE) - 1`` over e).  Sums by source and bin find the bin in which the
budget ends; only that bin's documents are sorted.

Defined results: null and empty texts have size 0 and nothing is taken of them; null
sources are a source of their own, last in order; ties of a key are ordered by id, then
size (rows alike in both are alike in the result); ids may be null; an empty table gives
an empty result; weights of 0, null or less count as a millionth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import WORD_PATTERN, stored

BINS_PER_OCTAVE = 256
#: Tables of sources up to this many rows are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000
#: Digits, marks and symbols whose share lowers a document's quality weight.
NOISE = "[#*$%&|<>!0-9]"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """1 for plain prose, down to 0.1 as noise characters reach a quarter of the text."""
    noise = F.regexp_count(F.col(text), F.lit(NOISE)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 4.0 * noise), F.lit(1.0))


def uniform(doc_id: str = "doc_id") -> Column:
    """A number in (0, 1) from the id's digest; the same in every run."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Target of each source (columns ``source``, ``source_size``): shares by weight, capped at
    ``most`` times the size, the excess reshared by weight until none is above its cap.

    Capped sources are those of least cap per weight, so the level at which the others stop
    follows from prefix sums in that order.  One row per source, in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("place", F.row_number().over(by_cap)).withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that stays within its cap holds for all that follow
    ranked = ranked.withColumn("common", F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("common.level"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: int = 2,
    weight: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``epochs`` (complete ones of the
    source), ``taken`` (words, repeats counted) and the ``keep`` columns of every document."""
    weight = quality_weight() if weight is None else weight
    sure = F.when(weight > 1e-6, weight.cast("double")).otherwise(1e-6)
    rows = docs.select("doc_id", "source", *keep, word_count().alias("size"), (-F.log(uniform()) / sure).alias("key"))
    rows = stored(rows.withColumn("bin", F.floor(F.log2("key") * BINS_PER_OCTAVE).cast("int")), "mix-keys")

    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    plan = plan.withColumn("epochs", F.coalesce(F.least(F.lit(most), F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))), F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))

    # the bin in which each source's budget ends, and the words before it
    below = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(below), F.lit(0)))
    edge = bins.withColumnRenamed("source", "_s").join(plan, F.col("_s").eqNullSafe(F.col("source")), "right")
    within = F.col("before") < F.col("budget")
    plan = stored(
        edge.groupBy("source", "source_size", "target", "epochs", "budget").agg(
            F.max(F.when(within, F.col("bin"))).alias("edge"), F.max(F.when(within, F.col("before"))).alias("before")
        ),
        "mix-plan",
    ).withColumnRenamed("source", "_s")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan

    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ahead = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = joined.where(F.col("bin") == F.col("edge"))
    at_edge = at_edge.withColumn("room", F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    part = F.least("size", F.greatest("room", F.lit(0)))
    whole = joined.where(F.col("edge").isNull() | (F.col("bin") != F.col("edge")))
    whole = whole.withColumn("room", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    out = at_edge.unionByName(whole)
    return out.select(
        "doc_id", "source", *keep, "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row once per complete epoch and once more if the sample takes
    it; the document at the budget's edge comes with its first words only."""
    columns = docs.columns
    rows = docs.withColumn("_row", F.struct(*columns))
    mixed = mix(rows, keep=("_row",), **options)
    left = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + F.when(left > 0, 1).otherwise(0)
    numbers = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    out = mixed.withColumn("_left", left).withColumn("_copy", F.explode(numbers))
    cut = (F.col("_copy") > F.col("epochs")) & (F.col("_left") < F.col("size"))
    pieces = F.split("_row.text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("_row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    text = F.when(cut, F.array_join(F.slice(pieces, 1, (F.col("_left") + lead).cast("int")), "")).otherwise(F.col("_row.text"))
    out = out.withColumn("_text", text)
    named = {"text": F.col("_text"), "n_chars": F.when(cut, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))}
    return out.select(*[named.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
