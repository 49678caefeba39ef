"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt to shards by hash.  Each shard becomes a hierarchical graph in flat
neighbour arrays (one table row per shard): on every level a node links to a diverse choice
of its nearest nodes on that level, and back.  Queries enter at the top level and walk with
a beam; the shards' results are scored again in double precision and merged.  How wide the beam
must be depends on the vectors: every shard doubles it until the walks of ``PROBES`` of its own
nodes find ``RECALL`` of their exact neighbours, or until the beam holds the whole shard.

Inner products are made navigable by one more coordinate that gives all vectors of a shard the
same norm, so that the largest product is the nearest point.  A shard holds vectors of one norm
band only (norms within a factor of 16), so a long vector leaves no others too short to be told
apart; links are chosen in double precision, and every query searches all bands.

Equal vectors are one node with its smallest ids (as many as one result can hold), found by
ranking in Spark, so a vector that a third of the rows share is never gathered.  Shards hold
``SHARD_ROWS`` nodes and query blocks ``QUERY_ROWS`` queries, whatever the table's size.  A task
loads a graph once and streams up to ``LANE_BLOCKS`` blocks of queries past it.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows without an id, take no part; repeated rows count once; only vectors of the query's
length are candidates; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, stored

by_value(__name__)

LINKS = 16  # per node on upper levels; twice as many on the lowest
CANDIDATES = 64  # nearest nodes that links are chosen from
BEAM = 160  # to begin with
RECALL = 0.97  # of a shard's probes, that its beam is widened for
PROBES = 128
EXPANDED = 16  # a walk expands one in so many of the beam's nodes at once
SHARD_ROWS = 32_768
MIN_SHARDS = 8
BAND = 4  # octaves of norm in one shard
QUERY_ROWS = 1024
LANE_BLOCKS = 64


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


# ---------------------------------------------------------------- graph


def choose(near: np.ndarray, sims: np.ndarray, points: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none), those nearer to the node than to any chosen before."""
    between = np.einsum("bcd,bed->bce", points[near], points[near])
    kept = np.zeros(near.shape, bool)
    for c in range(near.shape[1]):
        rival = (kept[:, :c] & (between[:, c, :c] > sims[:, c, None])).any(axis=1) if c else np.zeros(len(near), bool)
        kept[:, c] = ~rival & (near[:, c] >= 0) & (kept.sum(axis=1) < links)
    return kept


def level_links(points: np.ndarray, links: int, block: int = 256) -> np.ndarray:
    """Flat neighbour array (rows of ``links``, -1 for none) of one level's nodes."""
    n, k = len(points), min(CANDIDATES, len(points) - 1)
    out = np.full((n, links), -1, np.int32)
    if k < 1:
        return out
    froms, tos, weights = [], [], []
    for at in range(0, n, block):
        rows = np.arange(at, min(n, at + block))
        sims = points[rows] @ points.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        sims = np.take_along_axis(sims, near, 1)
        kept = choose(near, sims, points, links // 2)
        froms.append(np.repeat(rows, kept.sum(axis=1)))
        tos.append(near[kept])
        weights.append(sims[kept])
    a, b, w = map(np.concatenate, (froms, tos, weights))
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    a, b, w = a[first], b[first], w[first]
    # own choices are at most half of the row; links back fill the rest, nearest first
    order = np.lexsort((-w, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    ok = rank < links
    out[a[ok], rank[ok]] = b[ok]
    return out


def build(points: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest up: (nodes of the level, neighbour array by place in the level)."""
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(rng.random(len(points))) / math.log(LINKS)).astype(int)
    levels, level = [], 0
    while True:
        members = np.flatnonzero(height >= level)
        if not len(members):
            break
        levels.append((members.astype(np.int32), level_links(points[members], LINKS * (2 if level == 0 else 1))))
        level += 1
    return levels


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once; nodes (-1 for none) and products, best first."""
    q, n, width = len(queries), len(points), max(1, beam // EXPANDED)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)  # the last column takes what stands for no node
    seen[:, n] = True
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    k = min(beam, starts.shape[1])
    first = np.sort(starts, axis=1)
    repeated = np.concatenate([np.zeros((q, 1), bool), first[:, 1:] == first[:, :-1]], axis=1)
    s = np.einsum("qkd,qd->qk", points[first], queries)
    s[repeated | (first < 0)] = -np.inf
    order = np.argsort(-s, axis=1)[:, :k]
    ids[:, :k] = np.take_along_axis(np.where(np.isinf(s), -1, first), order, 1)
    sims[:, :k] = np.take_along_axis(s, order, 1)
    done[:, :k] = ids[:, :k] < 0
    seen[rows, ids] = True
    live = np.arange(q)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        best = np.argpartition(-open_sims, width - 1, axis=1)[:, :width]
        active = np.take_along_axis(open_sims, best, 1) > -np.inf
        some = active.any(axis=1)
        live, best, active = live[some], best[some], active[some]
        if not len(live):
            break
        done[live[:, None], best] |= active
        at = np.where(active, ids[live[:, None], best], -1)
        new = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        s = np.einsum("qkd,qd->qk", points[new], queries[live])
        s[new < 0] = -np.inf
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], new < 0], axis=1)
        order = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        sims[live] = np.take_along_axis(all_sims, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def search(points: np.ndarray, levels: list, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes near each query, by a walk down the levels."""
    starts = np.zeros((len(queries), 1), np.int32)
    for depth in range(len(levels) - 1, -1, -1):
        members, links = levels[depth]
        found, _ = walk(points[members], links, queries, starts, beam if depth == 0 else 16)
        nodes = np.where(found >= 0, members[found], -1)
        if depth:
            below = levels[depth - 1][0]
            place = np.searchsorted(below, nodes)  # every level's nodes are on the one below
            starts = np.where(nodes >= 0, place, -1).astype(np.int32)
    return nodes


def measured_beam(points: np.ndarray, levels: list, k: int, target: float = RECALL, probes: int = PROBES) -> int:
    """The beam at which walks find ``target`` of the ``k`` exact neighbours of the shard's probes."""
    n = len(points)
    some = np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int))
    # a query has no part in the coordinate that evens out norms
    queries = points[some].copy()
    queries[:, -1] = 0.0
    sims, k = queries @ points.T, min(k, n)
    least = np.partition(sims, n - k, axis=1)[:, n - k]
    beam = min(n, max(BEAM, k))
    while beam < n:
        found = search(points, levels, queries, beam)
        near = np.where(found >= 0, np.take_along_axis(sims, found, 1), -np.inf)
        if np.minimum((near >= least[:, None]).sum(axis=1), k).mean() >= target * k:
            break
        beam = min(n, 2 * beam)
    return beam


# ---------------------------------------------------------------- Spark


def nearest(vectors: DataFrame, is_query: str, k: int = 20, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` nearest rows found, itself left out."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.expr(is_query).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).groupBy("id", "v").agg(F.max("query").alias("query"))
    # -0.0 and 0.0 are one value when grouped
    rows = stored(rows, "nearest-rows")

    fewest = Window.partitionBy("v").orderBy("id")
    nodes = rows.withColumn("n", F.row_number().over(fewest)).where(F.col("n") <= k + 1)
    nodes = nodes.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = nodes.withColumn("dim", F.size("v")).withColumn("largest", F.array_max(F.transform("v", F.abs)))
    # scaled before squaring: no norm overflows or vanishes
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest")))
    nodes = nodes.withColumn("band", F.floor((F.log2("largest") + F.log2(square) / 2) / BAND).cast("int")).drop("largest")
    nodes = stored(nodes, "nearest-nodes")
    sizes = {r["band"]: r["n"] for r in nodes.groupBy("band").agg(F.count("*").alias("n")).collect()}  # 525 bands at most
    total, shards, bands = sum(sizes.values()), 0, []
    for band, n in sorted(sizes.items()):
        bands.append((band, shards, max(-(-n // SHARD_ROWS), -(-MIN_SHARDS * n // total))))
        shards += bands[-1][2]

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))  # any order of arrival gives one graph
        exact = np.stack(pdf["v"].to_numpy())
        scaled = exact / np.abs(exact).max()
        squares = (scaled * scaled).sum(axis=1)
        more = np.sqrt(np.maximum(0.0, squares.max() - squares))
        points = np.column_stack([scaled, more]) / math.sqrt(squares.max())
        levels = build(points)
        beam = measured_beam(points.astype(np.float32), levels, k)
        ids = pdf["ids"].tolist()
        flat = [x.astype("<i4").tobytes() for level in levels for x in level]
        return pd.DataFrame(
            {
                "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "beam": [beam], "vectors": [exact.astype("<f8").tobytes()],
                "points": [points.astype("<f4").tobytes()], "levels": [flat], "sizes": [[len(x) for x in ids]],
                "ids": [np.concatenate([np.asarray(x, "<i8") for x in ids]).tobytes()],
            }
        )

    placed = nodes.join(F.broadcast(spark.createDataFrame(bands, "band int, first int, parts int")), "band")
    shard = F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    graphs = placed.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(
        index, "dim int, shard int, beam int, vectors binary, points binary, levels array<binary>, sizes array<int>, ids binary"
    )
    graphs = stored(graphs, "nearest-graphs")

    queries = rows.where("query").select("id", "v", F.size("v").alias("dim"))
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    lanes = -(-blocks // LANE_BLOCKS)
    packed = queries.groupBy("dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"))
    packed = packed.agg(F.collect_list("id").alias("own"), F.flatten(F.collect_list("v")).alias("qs"))
    # every shard's graph once for each lane, and after it the lane's blocks of queries
    lane = F.pmod(F.col("block"), F.lit(lanes))
    graphs = graphs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("block", F.lit(-1))
    met = packed.withColumn("lane", lane).join(graphs.select("dim", "shard").distinct(), "dim")
    columns = ["dim", "shard", "lane", "block"]
    streams = graphs.unionByName(met, allowMissingColumns=True)
    streams = streams.repartition(max(shards * lanes, 1), *columns[:3]).sortWithinPartitions(*columns)

    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda name: batch.column(name)[i]
                dim = at("dim").as_py()
                if at("block").as_py() < 0:
                    exact = np.frombuffer(at("vectors").as_py(), "<f8").reshape(-1, dim)
                    points = np.frombuffer(at("points").as_py(), "<f4").reshape(len(exact), dim + 1)
                    flat = [np.frombuffer(x, "<i4") for x in at("levels").as_py()]
                    levels = [(m, x.reshape(len(m), -1)) for m, x in zip(flat[::2], flat[1::2])]
                    sizes, beam = np.array(at("sizes").as_py()), at("beam").as_py()
                    firsts, all_ids = np.cumsum(sizes) - sizes, np.frombuffer(at("ids").as_py(), "<i8")
                    continue
                own = at("own").values.to_numpy()
                qs = at("qs").values.to_numpy().reshape(len(own), dim)
                for first in range(0, len(qs), 128):
                    part = qs[first : first + 128]
                    unit = part / np.abs(part).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    nodes = search(points, levels, np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32), beam)
                    for j, found in enumerate(nodes):
                        found = found[found >= 0]
                        scores = (exact[found] * part[j]).sum(axis=1)
                        best = found[np.argsort(-scores, kind="stable")[: 4 * k]]
                        scores = np.sort(scores)[::-1][: 4 * k]
                        ids = np.concatenate([all_ids[firsts[x] : firsts[x] + sizes[x]] for x in best])
                        scores = np.repeat(scores, sizes[best])
                        other = ids != own[first + j]
                        ids, scores = ids[other], scores[other]
                        order = np.lexsort((ids, -scores))[:k]
                        if len(order):
                            yield own[first + j], ids[order], scores[order]

    schema = "query_id long, vec_id long, score double"

    def run(batches):
        import pyarrow as pa

        for q, ids, scores in find(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    found = streams.mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
