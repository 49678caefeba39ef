"""Source divergence audit over run-length columns.

Every language keeps the terms of at least ``min_docs`` of its documents; a group is a
(language, source).  A kept term of count c in a group has the share
``p = 1 + floor(10^9 (c + 2) / (N + 2 V))``, N the group's occurrences of kept terms and V
the number of kept terms; two shares differ by ``f = floor((p - q)^2 / (p + q))``.  All
arithmetic is exact.

The vocabulary of a language is a table whose columns are its groups' counts.  Terms with the
same counts in every group become one row with a length; the rows are ordered by their counts,
groups of few occurrences first, so that equal counts lie together.  Each column of a piece of the
ordered table is run-length encoded, the run boundaries of every pair of columns are
intersected, and f is computed once per common run and multiplied by its length.  Pieces
only cut runs, so their sums add up to the whole.

Scale: counts are combined in the map tasks and written once; their sums by term choose the kept
terms, and only these terms' counts by source go on, summed before and after the shuffle.  Equal rows are combined before the ordering, so a row that millions of terms
share is one; pieces are Arrow batches.  What grows without bound is only the number of pairs of
sources, which is the result itself.  Nothing is collected and nothing is broadcast by hand.

Defined results: null text, language and source are ``''``; a group without terms and a language
without kept terms give pairs of value 0 and no terms; a source alone in its language has no
pairs; repeated rows count as documents of their own; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, stored, utf8

by_value(__name__)

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Distinct (source, term) pairs that a task holds before it hands its counts on.
HELD_TERMS = 500_000
COUNT = [pa.field("source", pa.string()), pa.field("n", pa.int64())]
#: Bytes of terms: letters in lower case, everything beyond ASCII as it stands, the rest a gap.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``term``, its documents ``docs`` and occurrences ``in_lang`` and, by source, ``counts``; one or more
    rows for a term, each from as many documents as a task could combine."""
    target = pa.schema(
        [("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("in_lang", pa.int64()), ("counts", pa.list_(pa.struct(COUNT)))]
    )

    def combined(lang, groups):
        """Counters by source to one row per term."""
        names = list(groups)
        lengths = [len(groups[s][0]) for s in names]
        table = pa.table(
            {
                "term": pa.concat_arrays([pa.array(list(groups[s][0]), pa.binary()) for s in names]),
                "docs": pa.array([groups[s][1][t] for s in names for t in groups[s][0]], pa.int64()),
                "n": pa.concat_arrays([pa.array(list(groups[s][0].values()), pa.int64()) for s in names]),
                "s": pa.array(np.repeat(np.arange(len(names), dtype=np.int32), lengths)),
            }
        )
        rows = table.group_by("term", use_threads=False).aggregate([("docs", "sum"), ("n", "sum"), ("n", "list"), ("s", "list")]).combine_chunks()
        if not len(rows):
            return
        n, s = rows.column("n_list").chunk(0), rows.column("s_list").chunk(0)
        cells = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(s.values), n.values], fields=COUNT)
        counts = pa.ListArray.from_arrays(n.offsets, cells)
        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(rows), np.int32)))]
        columns += [rows.column(c).chunk(0).cast(t) for c, t in (("term", pa.string()), ("docs_sum", pa.int64()), ("n_sum", pa.int64()))]
        whole = pa.RecordBatch.from_arrays([*columns, counts], schema=target)
        yield from (whole.slice(at, 20_000) for at in range(0, len(whole), 20_000))

    def run(batches):
        held, size = {}, 0

        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = terms(raw)
                occurrences, documents = held.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                before = len(occurrences)
                occurrences.update(words)
                documents.update(set(words))
                size += len(occurrences) - before
                if size > HELD_TERMS:
                    for lang, groups in held.items():
                        yield from combined(lang, groups)
                    held, size = {}, 0
        for lang, groups in held.items():
            yield from combined(lang, groups)

    bound_batches(docs.sparkSession)
    named = docs.select(group_key("lang"), group_key("source"), utf8())
    return named.mapInArrow(run, "lang string, term string, docs long, in_lang long, counts array<struct<source:string,n:long>>")


def group_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), in decimals wide enough for any count."""
    return F.expr(f"1 + ((cast({n} as decimal(20,0)) + 2) * cast({SCALE} as decimal(10,0))) div (cast({total} as decimal(20,0)) + 2 * {kept})")


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for an array of counts."""
    values, places = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (n + 2) // (total + 2 * kept) for n in values.tolist()], np.int64)[places]


def run_lengths(column: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run ends (in terms) and values of a column whose rows end at ``ends``."""
    last = np.append(np.flatnonzero(column[1:] != column[:-1]), len(column) - 1)
    return ends[last], column[last]


def common_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of f over all terms of two columns of shares: once per intersected run, times its length."""
    ends = np.union1d(a[0], b[0])
    lengths = np.diff(ends, prepend=0)
    p, q = (values[np.searchsorted(at, ends)] for at, values in (a, b))
    return int(((p - q) ** 2 // (p + q) * lengths).sum())


def pair_sums(batches):
    """Sums of f for all pairs of groups over the rows of a task, by pieces of the ordered table."""
    lang, sums = None, None

    def flush():
        for g in range(len(sums)):
            for h in range(g + 1, len(sums)):
                yield lang, g, h, int(sums[g, h])

    for batch in batches:
        names = batch.column(0).to_pylist()
        counts = batch.column(1)
        rows = np.repeat(np.arange(len(names)), counts.value_lengths().to_numpy())
        cells = counts.flatten()
        groups, values = (cells.field(i).to_numpy() for i in (0, 1))
        lengths = batch.column(2).to_numpy()
        cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        for start, stop in zip(cuts, cuts[1:]):
            if names[start] != lang:
                if sums is not None:
                    yield from flush()
                lang = names[start]
                totals, kept = batch.column(3)[start].as_py(), batch.column(4)[start].as_py()
                sums = np.zeros((len(totals),) * 2, np.int64)
            inside = (rows >= start) & (rows < stop)
            dense = np.zeros((len(totals), stop - start), np.int64)
            dense[groups[inside], rows[inside] - start] = values[inside]
            ends = np.cumsum(lengths[start:stop])
            columns = []
            for counts_of, total in zip(dense, totals):
                at, count = run_lengths(counts_of, ends)
                columns.append((at, shares(count, total, kept) if kept else count + 1))
            for g in range(len(columns)):
                for h in range(g + 1, len(columns)):
                    sums[g, h] += common_runs(columns[g], columns[h])
    if sums is not None:
        yield from flush()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank`` of every group."""
    parts = stored(term_counts(docs), "term-parts")
    every = parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("in_lang").alias("in_lang"))
    vocabulary = stored(every.where(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
    entries = parts.select("lang", "term", "counts").join(vocabulary, ["lang", "term"]).select("lang", "term", "in_lang", F.inline("counts"))
    entries = stored(entries.groupBy("lang", "source", "term", "in_lang").agg(F.sum("n").alias("n")), "entries")

    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    groups = docs.select(group_key("lang"), group_key("source")).distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"])
    order = Window.partitionBy("lang").orderBy("total", "source")
    groups = stored(groups.withColumn("g", F.row_number().over(order) - 1), "groups")
    cells = entries.join(groups, ["lang", "source"])

    best = cells.select("lang", "source", F.col("term").alias("item"), share("n", "total", "kept").alias("p"), share("in_lang", "lang_total", "kept").alias("q"))
    best = best.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("cast(((p - q) * (p - q)) div (p + q) as long)").alias("value"))

    languages = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("g", "total", "source"))).alias("groups"), F.max("kept").alias("kept")
    )
    languages = languages.select("lang", F.col("groups.total").alias("totals"), F.col("groups.source").alias("sources"), "kept")
    columns = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("counts"))
    columns = columns.groupBy("lang", "counts").agg(F.count("*").alias("length"))
    # a row of no terms stands for every language, so that languages without kept terms have their pairs
    nothing = languages.select("lang", F.expr("cast(array() as array<struct<g:int,n:long>>)").alias("counts"), F.lit(0).cast("long").alias("length"))
    ordered = columns.unionByName(nothing).join(languages.drop("sources"), "lang")
    ordered = ordered.repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts")
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])

    def run(batches):
        out = []
        for row in pair_sums(batches):
            out.append(row)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    sums = ordered.mapInArrow(run, "lang string, g int, h int, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = sums.join(languages.select("lang", "sources"), "lang").select(
        "lang", "value", F.expr("sources[g]").alias("one"), F.expr("sources[h]").alias("other")
    )
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = named.select("lang", "value", both.alias("_s")).select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value")

    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(best)


#: The contract's result with the parameters above, as DuckDB SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d),
x AS (SELECT r, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
t AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
c AS (SELECT x.lang, source, x.term, count(*) AS n FROM x JOIN t ON x.lang = t.lang AND x.term = t.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (SELECT a.lang, a.source, coalesce(s.total, 0)::HUGEINT AS total, coalesce(v.v, 0)::HUGEINT AS v, v.total::HUGEINT AS lang_total
      FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN s ON s.lang = a.lang AND s.source = a.source LEFT JOIN v ON v.lang = a.lang),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
             1 + ({SCALE}::HUGEINT * (t.n + 2)) // (g.lang_total + 2 * g.v) AS q
      FROM g JOIN t ON t.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
