"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts become sets of hashed word n-grams.  Equal sets are one node.  A node has ``TREES``
signatures of ``DEPTH`` minima each; a tree is a sorted prefix trie of them.  Prefixes are
shortened, level by level, until two sets at the threshold share a prefix in some tree with
at least ``TARGET_RECALL`` (see :func:`forest_depth`); a shorter prefix holds all matches of
the longer ones, so the join goes over the prefixes of the last level.  Nodes that share
prefixes, directly or by others, form a candidate group; in a group **every** pair is
verified on the full sets, so inside groups the join is exact.

Hot groups: equal texts are counted before anything is joined.  Links go from a prefix's
nodes to its least node, never between all of them.  A group larger than ``BLOCK`` nodes is
dealt out as pairs of blocks, each its own small task, which count links and send back one
row per node and the edges of a spanning forest, never the pairs.

Defined results: null and empty texts have no n-grams and no links, each is its own class;
a text of fewer words than ``n`` has one n-gram, all its words; words are compared as they
stand; repeated rows (same or null ids too) count as documents of their own; the class id
is the least id in the class (null if all are null); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, map_rows, stored, utf8
from rankloom.llm.components import components

by_value(__name__)

N = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
TARGET_RECALL = 0.995
BLOCK = 512
SEED = 20


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = TARGET_RECALL) -> int:
    """Longest prefix at which a pair at the threshold still meets with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingles:
    """Hashed n-grams of texts; remembers the hashes of frequent words."""

    def __init__(self, n: int = N):
        self.n = n
        self.known: dict[bytes, int] = {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(n)], np.uint64)

    def word(self, word: bytes) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        h = self.known[word] = zlib.crc32(word) | zlib.crc32(word[::-1], len(word)) << 32
        return h

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.split()
        if not words:
            return np.zeros(0, np.uint64)
        known, new = self.known, self.word
        h = np.array([known.get(w) or new(w) for w in words], np.uint64)
        if len(h) < self.n:  # one n-gram of all words; their number keeps it apart
            h = np.concatenate([h, np.full(self.n - len(h), len(h), np.uint64)])
        out = np.zeros(len(h) - self.n + 1, np.uint64)
        for i in range(self.n):
            out += mixed(h[i : len(out) + i] ^ self.powers[i]) * self.powers[i]
        return np.unique(mixed(out))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_name(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    a = mixed(shingles + np.uint64(1)).sum(dtype=np.uint64)
    b = mixed(shingles ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)
    return np.array([mixed(np.array([a]))[0], mixed(np.array([b]))[0]], ">u8").tobytes()


class Forest:
    """Prefix hashes of a set in every tree, at one level."""

    def __init__(self, depth: int, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k = trees * depth
        self.shape = (trees, depth)
        self.multiply = rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, k, dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        minima = np.full(len(self.multiply), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):  # bounded memory for very long texts
            x = np.multiply.outer(self.multiply, low[at : at + 1024])
            x += self.add[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x += high[at : at + 1024]
            np.minimum(minima, x.min(axis=1), out=minima)
        out = np.arange(self.shape[0], dtype=np.uint64) + np.uint64(1)
        for level in minima.reshape(self.shape).T:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + level)
        return out.astype(np.int64)


def nodes(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """``doc_id``, ``node`` (name of the set, null if it is empty) and ``prefixes`` of every document."""
    depth = forest_depth(threshold)

    def run(batches):
        shingles, forest = Shingles(n), Forest(depth)
        for ids, raws in batches:
            for doc_id, raw in zip(ids, raws):
                s = shingles(raw)
                yield (doc_id, set_name(s), forest(s)) if len(s) else (doc_id, None, None)

    bound_batches(docs.sparkSession)
    return map_rows(docs.select(F.col("doc_id").cast("long"), utf8()), run, "doc_id long, node binary, prefixes array<long>", rows=2000)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 blocks over n-grams that both sides have."""
    ua, ub = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(ua, ub)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def places(values, rows):
        at = np.searchsorted(common, values)
        ok = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == values)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    if not len(common):
        return out
    (pa, ra), (pb, rb) = places(ua, ra), places(ub, rb)
    # an n-gram that one set of either side holds adds to single cells: no product needed
    na, nb = np.bincount(pa, minlength=len(common)), np.bincount(pb, minlength=len(common))
    rare = na * nb <= 4
    firsts_a, firsts_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    for i in range(4):
        for j in range(4):
            some = rare & (na > i) & (nb > j)
            np.add.at(out, (ra[firsts_a[some] + i], rb[firsts_b[some] + j]), 1)
    dense = np.flatnonzero(~rare)
    new = np.full(len(common), -1)
    new[dense] = np.arange(len(dense))
    for at in range(0, len(dense), 4096):
        width = min(4096, len(dense) - at)
        xa, xb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for x, p, r in ((xa, pa, ra), (xb, pb, rb)):
            c = new[p] - at
            ok = (c >= 0) & (c < width)
            x[r[ok], c[ok]] = 1
        out += xa @ xb.T
    return out


def forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            edges += [(at, int(x)) for x in new]
            front += new.tolist()
    return edges


def verify(groups: list[tuple[bytes, int, np.ndarray]], diagonal: bool, threshold: float):
    """Count links of one block (``diagonal``) or between two, and span them.

    ``groups`` holds (node, side, set); yields (node, links, other end of a spanning edge or null).
    The number of links is weighted with the other node's documents by the caller.
    """
    sides = [[g for g in groups if g[1] == s] for s in ((0,) if diagonal else (0, 1))]
    a, b = sides[0], sides[-1]
    if not a or not b:
        return
    sets_a, sets_b = [g[2] for g in a], [g[2] for g in b]
    n_a, n_b = (np.array([len(s) for s in x], np.float64) for x in (sets_a, sets_b))
    common = intersections(sets_a, sets_b).astype(np.float64)
    linked = common >= threshold * (n_a[:, None] + n_b[None, :] - common) - 1e-9
    w_a, w_b = (np.array([g[3] for g in x], np.int64) for x in (a, b))
    if diagonal:
        np.fill_diagonal(linked, False)
        counts = [(linked @ w_a, a)]
        full = linked
    else:
        counts = [(linked @ w_b, a), (linked.T @ w_a, b)]
        full = np.zeros((len(a) + len(b),) * 2, bool)
        full[: len(a), len(a) :] = linked
        full[len(a) :, : len(a)] = linked.T
    for links, side in counts:
        for k, g in zip(links.tolist(), side):
            if k:
                yield g[0], int(k), None
    every = a if diagonal else a + b
    for i, j in forest_edges(full):
        yield every[i][0], 0, every[j][0]


def near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``class_id`` (least id of its component), ``copy_id`` (least id with an equal set)
    and ``n_links`` (other documents at ``threshold`` or more) of every document."""
    named = stored(nodes(docs, n, threshold), "near-nodes")
    own = named.where("node is not null")
    sets = own.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"))

    # candidate groups: each prefix's nodes to its least node
    distinct = own.groupBy("node").agg(F.first("prefixes").alias("prefixes"))
    places = distinct.select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = places.groupBy("tree", "prefix").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = places.join(shared, ["tree", "prefix"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = components(links)
    counts = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = groups.join(counts, "component").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    members = members.join(sets, "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    bodies = docs.select(F.col("doc_id").cast("long"), utf8())
    texts = bodies.join(members.withColumnRenamed("copy_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "doc_id")
    texts = texts.select("text", "node", "component", "blocks", "block", "copies")

    def sets_of(batches):
        shingles = Shingles(n)
        for columns in batches:
            for raw, node, component, blocks, block, copies in zip(*columns):
                s = shingles(raw)
                if len(s) and set_name(s) == node:  # ids need not be unique
                    yield node, component, blocks, block, copies, s.tobytes()

    bound_batches(docs.sparkSession)
    dealt = map_rows(texts, sets_of, "node binary, component binary, blocks int, block int, copies long, shingles binary", rows=500)
    # block pairs i <= j: a block meets itself and every other once
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    pairs = dealt.withColumn("pair", F.explode(others)).select(
        "component", "pair.i", "pair.j", F.when(F.col("block") == F.col("pair.i"), 0).otherwise(1).alias("side"), "node", "copies", "shingles"
    )
    key = ["component", "i", "j"]
    sorted_pairs = pairs.repartition(*key).sortWithinPartitions(*key, "side", "node")

    def check(batches):
        last, group, diagonal = None, {}, False
        for columns in batches:
            for component, i, j, side, node, copies, raw in zip(*columns):
                if (component, i, j) != last:
                    if len(group) > 1:
                        yield from verify(list(group.values()), diagonal, threshold)
                    last, group, diagonal = (component, i, j), {}, i == j
                group[node] = (node, side, np.frombuffer(raw, np.uint64), copies)
        if len(group) > 1:
            yield from verify(list(group.values()), diagonal, threshold)

    found = stored(map_rows(sorted_pairs, check, "a binary, links long, b binary"), "near-links")
    classes = components(found.where("b is not null").select("a", "b"))
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    sets = sets.join(classes, "node", "left").join(counted, "node", "left")
    sets = sets.withColumn("component", F.coalesce("component", "node"))
    least = sets.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    sets = sets.join(least, "component").select(
        F.col("node").alias("_node"), "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = own.select("doc_id", "node").join(sets, F.col("node") == F.col("_node")).select("doc_id", "class_id", "copy_id", "n_links")
    alone = named.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)
