"""Centroid clustering (Lloyd's rounds, exact) with geometrically tightened bounds.

Components become integers ``floor(1024 x)``; distances, sums and centroids are exact integers.
Every vector keeps an upper bound of the distance to its centroid and a lower bound of the
distance to any other.  When centroids move, the upper bound grows by the own centroid's
drift.  The lower bound need not shrink by the largest drift: the members of a cluster lie in a
sphere around its old centroid, and a moving centroid comes nearer to a point by at most
``drift * cos(angle)``, the angle at the midpoint of the move between the move and the point.  In the
plane through both ends of the move and the sphere's centre, the least angle of any point of the sphere is
that of the centre less ``asin(radius / distance)``; this bounds the loss of the whole sphere.
A vector whose upper bound stays below its lower bound, or below half the way to the nearest
other centroid, keeps its cluster unread; the others are ambiguous and measured exactly.

Scale: vectors are packed once into blocks of ``BLOCK_ROWS``, a table bucketed by block in the
shared folder; a round reads it next to the bounds of the round before (ten bytes a vector,
bucketed alike, so nothing is shuffled) and writes the next bounds with the changed vectors' sums per
block.  Only k centroids, their sums and radii pass through the driver.  Rounds read written
tables, so a lost executor repeats no earlier round.

Defined results: vectors that are null, of another length, or hold null or non-finite
components take no part; repeated rows and ids count as vectors of their own; of equal ids
among the starting vectors the smaller components come first, null ids start last; fewer
vectors than k give as many clusters; integers beyond 2^27 are exact too (in Python integers), but a
distance, or a sum of them, that no long can hold is null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, map_rows, stored
from rankloom.session import shared_dir

by_value(__name__)

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = "3:"
BLOCK_ROWS = 4096
BLOCKS_PER_BUCKET = 16
MAX_BUCKETS = 50_000
#: Up to here sums of squares are exact in doubles (and matrix products may be used) or in longs.
DOUBLE_EXACT, LONG_EXACT = 1 << 22, 1 << 27
LIMB = 1 << 60


# ---------------------------------------------------------------- exact numbers


def integer(x: float) -> int:
    """floor(1024 x) of a finite double."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def largest(values: np.ndarray) -> int:
    return int(max(abs(values.max()), abs(values.min()))) if values.size else 0


def packed(rows: list[np.ndarray]) -> tuple[str, bytes]:
    """Kind and bytes of a block of integer vectors."""
    values = np.stack(rows)
    if values.dtype == object:
        return "text", ",".join(map(str, values.ravel().tolist())).encode()
    kind = "<i2" if largest(values) < 1 << 15 else "<i4"
    return kind, values.astype(kind).tobytes()


def unpacked(kind: str, raw: bytes, dims: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in raw.split(b",")], object).reshape(-1, dims)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(-1, dims)


class Centroids:
    """The current centroids, ready for exact squared distances."""

    def __init__(self, rows: list[list[int]]):
        exact = np.array(rows, object)
        self.wide = largest(exact) > LONG_EXACT
        self.rows = exact if self.wide else exact.astype(np.int64)
        self.limit = largest(exact)
        self.doubles = exact.astype(np.float64) if self.limit <= DOUBLE_EXACT else None
        self.squares = (self.doubles**2).sum(axis=1) if self.doubles is not None else None

    def all_distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to every centroid."""
        if self.doubles is not None and points.dtype != object and largest(points) <= DOUBLE_EXACT:
            x = points.astype(np.float64)
            return ((x**2).sum(axis=1)[:, None] + self.squares - 2 * (x @ self.doubles.T)).astype(np.int64)
        return np.stack([self.distances(points, np.full(len(points), c)) for c in range(len(self.rows))], axis=1)

    def distances(self, points: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances of points to one centroid each."""
        gap = points - self.rows[own]
        return (gap * gap).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite beyond their range."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(s) if s < 1 << 1000 else math.inf for s in squares.tolist()])


def above(x: np.ndarray) -> np.ndarray:
    """Four-byte floats not below x."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


# ---------------------------------------------------------------- bounds


def loosening(old: list[list[int]], new: list[list[int]], radius: list[float]) -> tuple[list[float], list[float]]:
    """Per cluster: its centroid's drift, and how much nearer any other centroid can have come to a member."""
    k = len(old)
    if largest(np.array(old + new, object)) > LONG_EXACT:  # beyond the bounds' arithmetic: measure all
        return [math.inf] * k, [math.inf] * k
    a, b = np.array(old, np.float64), np.array(new, np.float64)
    drift = np.sqrt(((b - a) ** 2).sum(axis=1))
    middle = (a + b) / 2
    loss = np.zeros(k)
    for own in range(k):
        for j in range(k):
            if j == own or drift[j] == 0:
                continue
            away = a[own] - middle[j]
            far = math.sqrt(away @ away)
            nearer = drift[j]
            if far > radius[own]:
                angle = math.acos(min(1.0, max(-1.0, away @ (b[j] - a[j]) / (far * drift[j]))))
                angle = max(0.0, angle - math.asin(radius[own] / far))
                nearer = min(nearer, drift[j] * (max(0.0, math.cos(angle)) + 1e-6))  # the rest is rounding
            loss[own] = max(loss[own], nearer)
    return (drift * (1 + 1e-9)).tolist(), (loss * (1 + 1e-9)).tolist()


def half_gaps(rows: list[list[int]]) -> list[float]:
    """Half the distance of each centroid to its nearest other."""
    c = Centroids(rows)
    out = []
    for i, row in enumerate(c.rows):
        gaps = c.distances(np.stack([row] * len(c.rows)), np.arange(len(c.rows)))
        out.append(min((g for j, g in enumerate(roots(gaps).tolist()) if j != i), default=math.inf) / 2 * (1 - 1e-9))
    return out


def assign(points, own, upper, lower, centroids: Centroids, gaps: np.ndarray):
    """Clusters and bounds after the centroids' move; only ambiguous vectors are measured."""
    safe = np.maximum(lower, gaps[own]) if len(gaps) > 1 else np.full(len(own), np.inf)
    unsure = np.flatnonzero(~(upper < safe))
    upper[unsure] = above(roots(centroids.distances(points[unsure], own[unsure])))
    unsure = unsure[~(upper[unsure] < safe[unsure])]
    if len(unsure):
        d = centroids.all_distances(points[unsure])
        first = d.argmin(axis=1)  # ties: the smaller number
        own[unsure] = first
        upper[unsure] = above(roots(d[np.arange(len(d)), first]))
        if d.shape[1] > 1:
            lower[unsure] = below(roots(np.partition(d, 1, axis=1)[:, 1]))
    return len(unsure)


def changed_sums(points: np.ndarray, before: np.ndarray, after: np.ndarray, k: int, dims: int) -> list[tuple[int, int, int, int]]:
    """(cluster, component, limb, value): what the changed vectors add to the clusters' sums (component -1: count)."""
    at = np.flatnonzero(before != after)
    out = []
    for c in np.unique(np.concatenate([before[at], after[at]])).tolist():
        if c < 0:
            continue
        gone, come = at[before[at] == c], at[after[at] == c]
        total = points[come].sum(axis=0) - points[gone].sum(axis=0)
        for d, value in enumerate([len(come) - len(gone), *np.asarray(total).tolist()], -1):
            sign, value, limb = (-1 if value < 0 else 1), abs(int(value)), 0
            while value:
                value, part = divmod(value, LIMB)
                if part:
                    out.append((c, d, limb, sign * part))
                limb += 1
    return out


# ---------------------------------------------------------------- rounds


def kept(vectors: DataFrame, dims: int, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part."""
    finite: Column = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dims) & finite)


def blocks_of(points: DataFrame, dims: int) -> DataFrame:
    """Blocks of integer vectors: ``block``, ``ids``, ``kind`` and ``raw``."""

    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        held = {False: ([], []), True: ([], [])}
        for ids, rows in batches:
            for vec_id, row in zip(ids, rows):
                scaled = np.floor(np.array(row) * SCALE)
                wide = not np.abs(scaled).max() <= LONG_EXACT
                names, points = held[wide]
                names.append(vec_id)
                points.append(np.array([integer(x) for x in row], object) if wide else scaled.astype(np.int64))
                if len(names) == BLOCK_ROWS:
                    yield part + number, names, *packed(points)
                    held[wide], number = ([], []), number + 1
        for names, points in held.values():
            if names:
                yield part + number, names, *packed(points)
                number += 1

    return map_rows(points, run, "block long, ids array<long>, kind string, raw binary", rows=8)


def bucketed(df: DataFrame, name: str, buckets: int) -> str:
    """Write a table of blocks to the shared folder, bucketed, so that it joins others without a shuffle; its name."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return name


STATE = (
    "block long, own binary, upper binary, lower binary, measured long, "
    "sums array<struct<c:int,d:int,limb:int,value:long>>, radius array<double>"
)


def next_state(blocks: DataFrame, state: DataFrame | None, rows: list[list[int]], drift: list[float], loss: list[float], dims: int) -> DataFrame:
    """Clusters and bounds of all vectors for the centroids ``rows``."""
    k, gaps = len(rows), np.array(half_gaps(rows))
    drift, loss = np.array(drift), np.array(loss)

    def run(batches):
        centroids = Centroids(rows)
        for columns in batches:
            for block, kind, raw, *bounds in zip(*columns):
                points = unpacked(kind, raw, dims)
                if bounds:
                    before = np.frombuffer(bounds[0], "<i2").astype(np.int64)
                    upper = above(np.frombuffer(bounds[1], "<f4").astype(np.float64) + drift[before])
                    lower = below(np.frombuffer(bounds[2], "<f4").astype(np.float64) - loss[before])
                    after = before.copy()
                else:
                    before = np.full(len(points), -1)
                    upper, lower = np.full(len(points), np.inf, np.float32), np.full(len(points), -np.inf, np.float32)
                    after = np.zeros(len(points), np.int64)
                measured = assign(points, after, upper, lower, centroids, gaps)
                radius = [float(upper[after == c].max(initial=0)) for c in range(k)]
                sums = changed_sums(points, before, after, k, dims)
                yield block, after.astype("<i2").tobytes(), upper.tobytes(), lower.tobytes(), measured, sums, radius

    columns = ["block", "kind", "raw"]
    if state is not None:
        blocks = blocks.join(state.select("block", "own", "upper", "lower").hint("merge"), "block")
        columns += ["own", "upper", "lower"]
    return map_rows(blocks.select(*columns), run, STATE, rows=64)


def measured_rows(blocks: DataFrame, state: DataFrame, rows: list[list[int]], dims: int) -> DataFrame:
    """``vec_id``, ``cluster`` and exact ``distance`` of every vector."""

    def run(batches):
        centroids = Centroids(rows)
        for columns in batches:
            for ids, kind, raw, own in zip(*columns):
                own = np.frombuffer(own, "<i2").astype(np.int64)
                distances = centroids.distances(unpacked(kind, raw, dims), own).tolist()
                yield from ((i, c, d if d < 1 << 63 else None) for i, c, d in zip(ids, own.tolist(), distances))

    both = blocks.join(state.select("block", "own").hint("merge"), "block").select("ids", "kind", "raw", "own")
    return map_rows(both, run, "vec_id long, cluster int, distance long", rows=BLOCK_ROWS)


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED, vector: str = "embedding", log: list | None = None
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every kept vector.

    ``log``, if given, receives the number of exactly scanned vectors of each round.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    points = kept(vectors, dims, vector)
    named = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = points.select(named.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    rows = [[integer(x) for x in r.v] for r in first]
    k = len(rows)

    blocks_needed = math.ceil(points.count() / BLOCK_ROWS)
    least = min(blocks_needed, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(MAX_BUCKETS, max(least, math.ceil(blocks_needed / BLOCKS_PER_BUCKET)))
    tables = [bucketed(blocks_of(points, dims).repartition(buckets, "block"), "blocks", buckets)]
    blocks = spark.table(tables[0])

    sums, counts = [[0] * dims for _ in rows], [0] * k
    state, drift, loss = None, [0.0] * k, [0.0] * k
    for step in range(rounds + 1):
        tables.append(bucketed(next_state(blocks, state, rows, drift, loss, dims), "bounds", buckets))
        state = spark.table(tables[-1])
        if log is not None:
            log.append(state.agg(F.sum("measured")).first()[0])
        if step == rounds:
            break
        exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
        for c, d, limb, value in state.select(F.inline("sums")).groupBy("c", "d", "limb").agg(exact).collect():
            if d < 0:
                counts[c] += int(value) * LIMB**limb
            else:
                sums[c][d] += int(value) * LIMB**limb
        reach = state.select(F.posexplode("radius").alias("c", "r")).groupBy("c").agg(F.max("r").alias("r")).collect()
        radius = {c: r for c, r in reach}
        new = [[s // n for s in sums[c]] if (n := counts[c]) else rows[c] for c in range(k)]
        drift, loss = loosening(rows, new, [radius[c] for c in range(k)])
        rows = new

    found = stored(measured_rows(blocks, state, rows, dims), "clustered")
    for name in tables:  # names of this session; the files stay in the shared folder like all others
        spark.sql(f"DROP TABLE {name}")
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {c: v for c, v in found.groupBy("cluster").agg(whole.alias("v")).collect()}

    def long(value):
        return F.lit(None if value is None or value >= 1 << 63 else int(value)).cast("long")

    total = None if None in inertia.values() else sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    return found.select(
        "vec_id", "cluster", "distance",
        F.array(*[long(inertia.get(c, 0)) for c in range(k)])[F.col("cluster")].alias("cluster_inertia"),
        long(total).alias("inertia"),
        F.array(*[F.lit(d) for d in digests])[F.col("cluster")].alias("centroid_sha256"),
    )


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED) -> str:
    """The contract's result as DuckDB SQL: every round is one assignment and one update over all components."""
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        "x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e)",
        f"""f AS (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS c, v FROM e ORDER BY sha256('{seed}' || vec_id), v LIMIT {k})""",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM f)",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS s FROM x JOIN c{i} c ON x.d = c.d GROUP BY x.r, c.c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM d{i} GROUP BY r)")
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN
      (SELECT a.c, x.d, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{i} a JOIN x ON x.r = a.r GROUP BY a.c, x.d) n
      ON n.c = o.c AND n.d = o.d)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT e.vec_id, a.c::INTEGER AS cluster, a.s::BIGINT AS distance, (sum(a.s) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.s) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN e ON e.r = a.r JOIN (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) h ON h.c = a.c
"""
    )
