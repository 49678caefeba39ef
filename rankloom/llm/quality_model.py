"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every text becomes a sparse vector: its distinct words, hashed to ``BUCKETS`` features with
damped counts, and one active bin for each structure statistic and for the stored length.
The score is the logistic of a bias, a linear part and all pairwise interactions through
``FACTORS`` latent factors; the sum-of-squares identity gives the pairs in time linear in
the active features.  Labels, language, source and id are never inputs.

The model is fitted on at most ``SAMPLE_PER_CLASS`` labelled training rows of each label,
chosen by hash among the rows of the training folds.

Defined results: null and empty texts have structure bins only and get a score like every
text; null lengths have a bin of their own; without labels of both classes every score is
0.5; a null id is never held out nor learned from; several labels of one id count as the
smallest; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, map_rows, sigmoid, utf8

by_value(__name__)

BUCKETS = 1 << 16
FACTORS = 8
BINS = 12
FOLDS = 5
SAMPLE_PER_CLASS = 4000
EPOCHS = 4
BATCH = 64
KEPT_WORDS = 500_000  # hashed words remembered per task

UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
STATS = 11
FEATURES = BUCKETS + STATS * BINS


def share(part: float, whole: float) -> int:
    """Bin of a share: none, then finer bins for small shares."""
    if part <= 0 or whole <= 0:
        return 0
    return max(1, BINS - 1 - int(-math.log2(min(1.0, part / whole)) * 1.5))


def statistics(raw: bytes, words: list[bytes], distinct: int, n_chars: int | None) -> list[int]:
    """One bin for each structure statistic, and one for the stored length."""
    size, n = len(raw), len(words)
    without = lambda chars: size - len(raw.translate(None, chars))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = raw.split(b"\n")
    return [
        min(BINS - 1, n.bit_length()),
        min(BINS - 1, size // n if n else 0),
        share(without(UPPER), size),
        share(raw.count(b"!"), n),
        share(without(SYMBOLS), n),
        share(raw.count(b"|"), n),
        share(without(DIGITS), size),
        share(distinct, n),
        share(repeats, n),
        share(len(lines) - len(set(lines)), len(lines)),
        BINS - 1 if n_chars is None else min(BINS - 2, max(0, n_chars).bit_length() // 2),
    ]


class Vectors:
    """Active features and values of texts; remembers the hashes of frequent words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = raw.lower().split()
        counts = Counter(words)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        hashed = [known.get(w) for w in counts]
        if None in hashed:
            for i, w in enumerate(counts):
                if hashed[i] is None:
                    hashed[i] = known[w] = zlib.crc32(w) % BUCKETS
        values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        norm = float(np.sqrt((values * values).sum())) or 1.0
        stats = statistics(raw, words, len(counts), n_chars)
        index = np.array(hashed + [BUCKETS + BINS * i + b for i, b in enumerate(stats)], np.int64)
        return index, np.concatenate([values / norm, np.full(len(stats), 1 / math.sqrt(len(stats)), np.float32)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """Pairs by the identity: half of the squared sums less the sums of squares."""
        v = self.factors[index] * value[:, None]
        sums = v.sum(axis=0)
        pairs = 0.5 * float((sums * sums).sum() - (v * v).sum())
        return float(sigmoid(self.bias + float(self.linear[index] @ value) + pairs))


def train(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Stochastic gradient steps with per-weight rates; classes weigh alike."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        machine.factors[:] = 0
        return machine
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    w2, v2, b2 = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([vectors[i][0] for i in some])
            x = np.concatenate([vectors[i][1] for i in some])
            sizes = np.array([len(vectors[i][0]) for i in some])
            first = np.cumsum(sizes) - sizes
            xv = machine.factors[index] * x[:, None]
            sums = np.add.reduceat(xv, first)
            z = machine.bias + np.add.reduceat(machine.linear[index] * x, first)
            z = z + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((xv * xv).sum(1), first))
            g = (sigmoid(z) - labels[some]) * weight[some]
            row = np.repeat(g, sizes).astype(np.float32) * x
            gv = row[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
            used, place = np.unique(index, return_inverse=True)
            gw = np.bincount(place, row, len(used)).astype(np.float32) / len(some) + 1e-5 * machine.linear[used]
            gf = np.stack([np.bincount(place, gv[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) / len(some)
            gf += 1e-4 * machine.factors[used]
            w2[used] += gw * gw
            v2[used] += gf * gf
            machine.linear[used] -= 0.2 * gw / np.sqrt(w2[used])
            machine.factors[used] -= 0.02 * gf / np.sqrt(v2[used])
            gb = float(g.mean())
            b2 += gb * gb
            machine.bias -= 0.1 * gb / math.sqrt(b2)
    return machine


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit on a sample of at most ``per_class`` rows of each label, outside fold 0."""
    bound_batches(docs.sparkSession)
    own = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold() != 0)
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = None
    for label in (0, 1):
        part = own.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.union(part)
    # at most 2 * per_class ids
    rows = docs.select("doc_id", utf8(), "n_chars").join(F.broadcast(some), "doc_id").select("doc_id", "text", "n_chars", "quality")

    def vectors(batches):
        make = Vectors()
        for ids, raws, chars, qualities in batches:
            for doc_id, raw, n, quality in zip(ids, raws, chars, qualities):
                index, value = make(raw, n)
                yield doc_id, index.astype("<i4").tobytes(), value.astype("<f4").tobytes(), quality

    made = map_rows(rows, vectors, "doc_id long, x binary, v binary, y int")
    # repeated ids count once, so the driver gets at most 2 * per_class vectors
    found = made.groupBy("doc_id").agg(F.min(F.struct("x", "v", "y")).alias("r")).select("doc_id", "r.*").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    sparse = [(np.frombuffer(r["x"], "<i4").astype(np.int64), np.frombuffer(r["v"], "<f4")) for r in found]
    return train(sparse, np.array([r["y"] for r in found], np.float64))


def score(docs: DataFrame, machine: Machine, least: float = 0.3) -> DataFrame:
    """Score and prediction of every document."""
    bound_batches(docs.sparkSession)
    # of fixed size: FEATURES * (FACTORS + 1) floats
    # plain arrays: executors need no copy of the package
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(batches):
        make, model = Vectors(), Machine(*shared.value)
        for ids, raws, chars, held in batches:
            for doc_id, raw, n, h in zip(ids, raws, chars, held):
                p = model.score(*make(raw, n))
                yield doc_id, h, p, int(p >= least)

    rows = docs.select("doc_id", utf8(), F.col("n_chars").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int")
