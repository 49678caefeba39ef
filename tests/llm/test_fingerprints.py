"""Spot signatures, source divergence and centroids against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import centroids, divergence, spot_signatures
from rankloom.llm.spot_signatures import ANCHORS, CHAIN, Signatures, fingerprint, likeness

# ------------------------------------------------------------------ spot signatures


def brute_signatures(text: str) -> set:
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return {text} if text else set()
    common = [w.encode() in ANCHORS for w in words]
    if all(common):
        return {tuple(words[i : i + CHAIN]) for i in range(len(words))}
    out = set()
    for i, w in enumerate(words):
        chain = [x for x, c in zip(words[i + 1 :], common[i + 1 :]) if not c][:CHAIN]
        if common[i] and chain:
            out.add((w, *chain))
    content = [w for w, c in zip(words, common) if not c]
    return out or {tuple(content[i : i + CHAIN]) for i in range(len(content))}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures_are_chains_after_anchors():
    make = Signatures()
    texts = ["", "!!", "the", "the of and", "alpha beta", "The quick brown fox of the hills jumps over a dog and sleeps", "Über den Wolken ist es schön und weit"]
    for a in texts:
        assert len(make(a.encode())) == len(brute_signatures(a)) == len(fingerprint(make(a.encode()))) / 8
        for b in texts:
            assert likeness(make(a.encode()), make(b.encode())) == pytest.approx(jaccard(brute_signatures(a), brute_signatures(b)))
    assert likeness(make(b"the cat sat on the mat"), make(b"the cat"), 0.9) == 0.0


def check_edited(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = spot_signatures.edited_report(docs).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in rows)))
    by_text = defaultdict(set)
    texts = dict(rows)
    order = sorted((i for i, _ in rows if i is not None), reverse=True)
    repeated = {i for i, n in Counter(i for i, _ in rows).items() if n > 1}
    has_null = any(i is None for i, _ in rows)
    for at, r in enumerate(sorted((r for r in got if r.doc_id is not None), key=lambda r: -r.doc_id)):
        after = order[(at + 1) % len(order)]
        if r.doc_id in repeated or after in repeated or (has_null and at == len(order) - 1):
            continue  # the order among equal ids is the hash's
        text, follow = texts[r.doc_id], texts[after]
        n = len(text)
        edited = text[: n - n // 3] + follow[: n // 3]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = brute_signatures(text)
        assert len(r.fingerprint) == 8 * len(own)
        assert r.near_edited == pytest.approx(jaccard(own, brute_signatures(edited)))
        assert r.near_next == pytest.approx(jaccard(own, brute_signatures(follow)))
        by_text[text].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_edited_report(spark, nasty, small, empty):
    check_edited(nasty)
    check_edited(small)
    assert spot_signatures.edited_report(empty).count() == 0
    one = spark.createDataFrame([(7, "the one text of all")], "doc_id long, text string")
    row = spot_signatures.edited_report(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"the one text the on").hexdigest()[:64]


def test_every_row_meets_its_successor_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "RANGE_BYTES", 2000)
    rng = random.Random(4)
    ids = rng.sample(range(-5000, 5000), 400)
    rows = [(i, f"text of the number {i} " + "word " * rng.randint(0, 60)) for i in ids] + [(None, f"n{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    pairs = spot_signatures.with_next(docs, lambda rows: ((i, t.decode(), a.decode()) for i, t, a in rows), "doc_id long, text string, after string").collect()
    assert len(pairs) == 600 and Counter(p.text for p in pairs) == Counter(p.after for p in pairs)
    follows = {p.doc_id: p.after for p in pairs if p.doc_id is not None}
    order = sorted(ids, reverse=True)
    texts = dict(rows)
    assert all(follows[a] == texts[b] for a, b in zip(order, order[1:]))
    nulls = {p.text: p.after for p in pairs if p.doc_id is None}
    at, seen = follows[order[-1]], set()
    while at in nulls:
        seen.add(at)
        at = nulls[at]
    assert len(seen) == 200 and at == texts[order[0]]  # one ring through all rows


def test_near_texts(spark, nasty, small, empty, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BLOCK", 3)  # many blocks even in small index entries
    for docs in (nasty, small):
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        sets = [brute_signatures(t) for _, t in rows]
        parent = list(range(len(rows)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = [0] * len(rows)
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and min(len(a), len(b)) >= 0.79 * max(len(a), len(b)) and jaccard(a, b) >= 0.8 - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
        least = {}
        for i, (doc_id, _) in enumerate(rows):
            r = root(i)
            ids = [x for x in (least.get(r), doc_id) if x is not None]
            least[r] = min(ids) if ids else None
        want = Counter((doc_id, least[root(i)], links[i]) for i, (doc_id, _) in enumerate(rows))
        assert Counter(tuple(r) for r in spot_signatures.near_texts(docs).collect()) == want
    assert spot_signatures.near_texts(empty).count() == 0


# ------------------------------------------------------------------ divergence


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rows = con.execute(sql)
    names = [d[0] for d in rows.description]
    return names, rows.fetchall()


def test_divergence_equals_its_sql(spark, nasty, small, empty):
    extra = [(i, "Alpha beta " * (i % 7) + "größe x" * (i % 3), ("xx", None, "")[i % 3], (None, "a", "", "b")[i % 4], i, "k", None) for i in range(90)]
    extra += [(900 + i, None, "zz", f"s{i}", 0, None, None) for i in range(3)]  # a language without terms
    varied = nasty.unionByName(spark.createDataFrame(extra, nasty.schema))
    for docs in (small, varied):
        names, want = duck(divergence.SQL, documents=docs)
        got = divergence.audit(docs).select(*names).collect()
        assert Counter(tuple(r) for r in got) == Counter(want) and got
    assert divergence.audit(empty).count() == 0


def test_common_runs_equal_the_sum_over_terms():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 5, 300)
    a, b = (np.sort(rng.integers(0, 9, 300)) for _ in range(2))
    p, q = (divergence.shares(x, int((x * lengths).sum()), int(lengths.sum())) for x in (a, rng.permutation(b)))
    ends = np.cumsum(lengths)
    want = sum(int((x - y) ** 2 // (x + y)) * int(n) for x, y, n in zip(p.tolist(), q.tolist(), lengths.tolist()))
    assert divergence.common_runs(divergence.run_lengths(p, ends), divergence.run_lengths(q, ends)) == want
    assert divergence.shares(np.array([10**15]), 10**16, 5).tolist() == [1 + 10**9 * (10**15 + 2) // (10**16 + 10)]


# ------------------------------------------------------------------ centroids


def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**50 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in start]
    points = np.array([v for _, v in kept], object)

    def assigned():
        d = np.stack([((points - np.array(c, object)) ** 2).sum(axis=1) for c in cents], axis=1)
        a = d.argmin(axis=1)
        return a, d[np.arange(len(a)), a]

    for _ in range(rounds):
        a, _ = assigned()
        cents = [[int(s) // int((a == c).sum()) for s in points[a == c].sum(axis=0)] if (a == c).any() else cents[c] for c in range(len(cents))]
    a, d = assigned()
    inertia = Counter()
    for c, x in zip(a.tolist(), d.tolist()):
        inertia[c] += x
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, int(x), int(inertia[c]), int(sum(inertia.values())), digests[c]) for (i, _), c, x in zip(kept, a.tolist(), d.tolist()))


EMBEDDINGS = "vec_id long, embedding array<double>, label int, v string, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], EMBEDDINGS).repartition(3)


def test_centroids(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 64)) + rng.integers(0, 5, (700, 1)))]
    rows += rows[:40] + [(None, rows[5][1]), (900, [0.0] * 64), (901, [0.0] * 64)]
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [None] + [1.0] * 63), (1003, [float("nan")] + [1.0] * 63), (1004, [float("inf")] * 64), (1005, [])]
    log = []
    got = centroids.cluster(vectors(spark, rows), log=log)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows)
    assert log[0] > 600 and len(log) == 11 and sum(log[1:]) < 0.9 * 10 * 743  # later rounds measure fewer
    few = rows[:3]
    assert Counter(tuple(r) for r in centroids.cluster(vectors(spark, few)).collect()) == brute_clusters(few)
    same = [(i, [0.5] * 64) for i in range(30)]  # ties everywhere, empty clusters
    assert Counter(tuple(r) for r in centroids.cluster(vectors(spark, same)).collect()) == brute_clusters(same)
    assert centroids.cluster(vectors(spark, rows[-6:])).count() == 0
    assert centroids.cluster(vectors(spark, []).limit(0)).count() == 0


def test_centroids_of_wide_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * (1 if i % 3 else 30_000)).tolist()) for i in range(60)]  # longs, not doubles
    assert Counter(tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()) == brute_clusters(rows)
    rows += [(100, [1e300] * 64), (101, [-1e300] * 64)]
    want = {(r[0], r[1], r[5]) for r in brute_clusters(rows)}
    got = centroids.cluster(vectors(spark, rows)).collect()
    assert {(r.vec_id, r.cluster, r.centroid_sha256) for r in got} == want


def test_loosening_bounds_the_loss_of_a_sphere():
    rng = np.random.default_rng(7)
    less = 0
    for _ in range(60):
        old = rng.integers(-900, 900, (4, 6))
        new = old + rng.integers(-80, 80, (4, 6))
        radius = rng.uniform(0, 400, 4)
        drift, loss = centroids.loosening(old.tolist(), new.tolist(), radius.tolist())
        for own in range(4):
            x = rng.normal(size=(4000, 6))
            x = old[own] + x / np.linalg.norm(x, axis=1)[:, None] * radius[own]
            for j in range(4):
                if j != own:
                    nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                    assert nearer.max() <= loss[own] + 1e-6
            less += loss[own] < 0.95 * max(d for j, d in enumerate(drift) if j != own)
    assert less > 60  # tighter than the largest drift
