"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import nearest

QUERY = "vec_id % 20 = 0"


def brute(rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = lists(nearest.nearest(df, QUERY)), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys() and {len(x) for x in got.values()} == {20}
    assert recall(got, want) >= 0.95
    exact = {q: dict(w) for q, w in want.items()}
    assert all(abs(exact[q].get(v, s) - s) < 1e-9 for q, g in got.items() for v, s in g)


def test_full_shard_of_unclustered_vectors():
    rng = np.random.default_rng(8)
    exact = rng.normal(size=(nearest.SHARD_ROWS, 64))
    norms = (exact * exact).sum(axis=1)
    points = (np.column_stack([exact, np.sqrt(norms.max() - norms)]) / np.sqrt(norms.max())).astype(np.float32)
    levels = nearest.build(points)
    beam = nearest.measured_beam(points, levels, 20)
    assert beam > nearest.BEAM
    some = rng.choice(len(exact), 200, replace=False)
    queries = exact[some] / np.linalg.norm(exact[some], axis=1, keepdims=True)
    found = nearest.search(points, levels, np.column_stack([queries, np.zeros(200)]).astype(np.float32), beam)
    hits = 0
    for q, nodes, own in zip(queries, found, some):
        s = exact @ q
        s[own] = -np.inf
        got = [x for x in nodes if x != own][:20]
        hits += len(set(got) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 200


def test_unequal_norms_and_unusual_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 5)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one vector in a third of the rows
    usable = list(rows)
    rows += rows[:5] + [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(2100, [1.0, 2.0]), (2101, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = lists(nearest.nearest(df, QUERY))
    assert got.pop(2100) == [(2101, 6.0)]
    want = brute(usable)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
    assert [v for v, _ in got[1000]] == [v for v, _ in want[1000]]  # ties go to smaller ids
    assert nearest.nearest(df.limit(0), QUERY).count() == 0


def test_norm_outliers_leave_recall_as_it_is(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    rows += [(2001, (rng.normal(size=16) * 1e6).tolist()), (2002, (rng.normal(size=16) * 1e200).tolist()), (2003, (rng.normal(size=16) * 1e-200).tolist())]
    got, want = lists(nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), QUERY)), brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
