"""Vector retrieval and checks of stored replies."""

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import replies, reports
from rankloom.operators import retrieval as R


def test_own_encoder_keeps_the_two_best(spark):
    def keyword_encoder():
        return lambda texts: np.asarray([[1.0 if "python" in t.lower() else 0.0] for t in texts], dtype="float32")

    df = spark.createDataFrame([(i, "Python" if i in (3, 7) else "Excel") for i in range(10)], "id long, text string").repartition(4)
    found = R.retrieve(df, R.embed_column(F.col("text"), keyword_encoder), [(0, [1.0])], 2, row_id="id").collect()
    assert {r["id"] for r in found} == {3, 7} and all(r["score"] == 1.0 for r in found)


def test_missing_encoder_falls_back_to_hashed_tokens(spark):
    def broken():
        raise ImportError("no model here")

    df = spark.createDataFrame([("a b a",), ("",)], "text string")
    rows = [np.array(r[0]) for r in df.select(R.embed_column(F.col("text"), broken)).collect()]
    assert np.allclose(rows[0], R.hash_vectors(["a b a"])[0]) and not rows[1].any()


def test_matches_brute_force_over_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data, wanted = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>").repartition(6)
    monkeypatch.setattr(R, "MAX_QUERY_VALUES", 16)
    queries = [(i, q.tolist()) for i, q in enumerate(wanted)]
    got = R.retrieve(df, F.col("v"), queries, 4, row_id="id").collect()
    for i, q in enumerate(wanted):
        best = np.argsort(-(data @ q))[:4]
        assert {r["id"] for r in got if r["query_id"] == i} == set(best.tolist())
    one = R.retrieve_one(df, F.col("v"), queries[0][1], 4, row_id="id").collect()
    assert [r["id"] for r in one] == np.argsort(-(data @ wanted[0]))[:4].tolist()


def test_best_rows_live_across_batches():
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(500, 3)), 1)  # many ties
    ids = np.array([f"r{i:03d}" for i in rng.permutation(500)], object)
    best = R.BestRows(40, 3)
    for at in range(0, 500, 7):
        best.add(ids[at : at + 7], scores[at : at + 7], scores[at : at + 7])
    for j, (compared, _, rows) in enumerate(best.found):
        order = sorted(range(500), key=lambda i: (-scores[i, j], ids[i]))[:40]
        assert rows.tolist() == ids[order].tolist() and compared.tolist() == scores[order, j].tolist()


def test_query_table_in_blocks_gives_up_k_rows_per_task(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_HELD_ROWS", 60)
    monkeypatch.setattr(R, "VECTOR_ROWS", 16)
    rng = np.random.default_rng(6)
    data, wanted = rng.integers(-3, 4, (600, 6)).astype(float), rng.integers(-3, 4, (11, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(999, None)], "id long, v array<double>").repartition(4)
    table = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(wanted)], "name string, q array<double>")
    found = R.retrieve(df, F.col("v"), table, 20, row_id="id", query_id="name", query_vector=F.col("q"))
    got = {}
    for r in found.collect():
        got.setdefault(r["name"], set()).add((r["id"], r["score"]))
    for i, q in enumerate(wanted):
        scores = data @ q
        order = sorted(range(600), key=lambda j: (-scores[j], j))[:20]
        assert got[f"q{i}"] == {(j, scores[j]) for j in order}


def test_sparse_vectors_are_row_local(spark):
    df = spark.createDataFrame([(1, "A a b  c"), (2, ""), (3, None)], "id int, text string")
    for plan in (R.hash_buckets(df, "id", "text"), R.vector_norms(df, "id", "text"), R.cosine_sparse(df, "id", "text", [1.0] * 384)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["score"] for r in R.cosine_sparse(df, "id", "text", [0.0] * 384).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_replies(spark):
    texts = ['{"name":"Ada"}', "not-json", '```json\n{"name":"Bo"}\n```', '{"other":1}', '{"name": 5}', "```", "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    rows = replies.validate_replies(df, "content", "name string", ["name"]).collect()
    status = [r["status"] for r in rows]
    assert status[:4] == ["ok", "invalid_json", "ok", "invalid_shape"] and status[5:] == ["invalid_json", "invalid_shape"]
    assert rows[2]["parsed"]["name"] == "Bo"


def test_explanation_rows(spark):
    text = '{"explanations":[{"candidate_id":"a","summary":"s","recruiter_rationale":["r"],"interview_focus":[],"risk_notes":[]}]}'
    df = spark.createDataFrame([(text,), ("{}",), ("x",)], "content string")
    rows = replies.explanation_rows(df, "content").collect()
    assert [(r["pos"], r["candidate_id"], r["recruiter_rationale"]) for r in rows] == [(0, "a", ["r"])]


def test_the_later_reply_explains_last(spark):
    reply = '{"explanations":[%s{"candidate_id":"a","summary":"%s","recruiter_rationale":[],"interview_focus":[],"risk_notes":[]}]}'
    other = '{"candidate_id":"b","summary":"first","recruiter_rationale":[],"interview_focus":[],"risk_notes":[]},'
    df = spark.createDataFrame([(2, reply % ("", "late")), (1, reply % (other, "early"))], "at int, content string")
    notes = replies.explanation_rows(df, "content", order="at")
    ranked = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_id string")
    rows = {r["candidate_id"]: r["explanation"] for r in reports.explanation_lookup(ranked, notes, "pos").collect()}
    assert (rows["a"]["summary"], rows["b"]["summary"], rows["c"]) == ("late", "first", None)


def overlap_rows(n):
    return [(i, ["every", f"word{i % 7}", f"own{i}"]) for i in range(n)] + [(n, []), (n + 1, None), (None, ["every"])]


def test_token_overlap_of_a_token_in_every_text(spark):
    terms = [("j1", "every word3", "every", 2), ("j1", "every word3", "word3", 2), ("j2", "own5", "own5", 1), ("j2", "none", "none", 1)]
    docs = spark.createDataFrame(overlap_rows(400), "id long, tokens array<string>")
    table = spark.createDataFrame(terms, "jd_id string, term string, token string, n_tokens int")
    want = {}
    for key, tokens in overlap_rows(400):
        for jd, term, token, n in terms:
            if token in (tokens or []):
                want[key, jd, term] = want.get((key, jd, term), 0) + 1 / n
    for key_rows in (20, 100_000):
        got = R.token_overlap_join(docs, "id", F.col("tokens"), table, key_rows=key_rows).collect()
        assert {(r.id, r.jd_id, r.term): r.coverage for r in got} == want and len(got) == len(want)
    dealt, repeated = R.dealt_tokens(docs, "id", F.col("tokens"), table, 1000, 20)
    sizes = [r["count"] for r in dealt.where("token in ('every', 'word3', 'own5')").groupBy("token", "_part").count().collect()]
    assert max(sizes) <= 60 and sum(sizes) > 400
    assert repeated.where("token = 'every'").count() == 21
    none = spark.createDataFrame([], table.schema)
    assert R.token_overlap_join(docs, "id", F.col("tokens"), none).count() == 0


def test_backfill_moves_no_row_that_the_shortlist_does_not_name(spark):
    from rankloom.plans.ranking import raw_backfill

    source = spark.range(1000).select(F.col("id").alias("key"), F.concat(F.lit("text"), "id").alias("raw"))
    best = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("b", None), ("b", 5000)], "jd_id string, key long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = raw_backfill(best, source, ["key"], ["raw"])
        assert sorted((r.jd_id, r.raw) for r in found.collect()) == [("a", "text1"), ("a", "text5"), ("b", "text5")]
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")  # the filter is below the join
        everything = raw_backfill(best, source, ["key"], ["raw"], max_keys=1)
        assert everything.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _above_generator(df) -> str:
    """The optimized plan's lines above its generator: what runs once for each entry of a vector."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Generate ")]


def test_vectors_and_norms_are_computed_once_a_row(spark, tmp_path):
    from rankloom.plans.queries import QUERIES

    rows = [(1, "a b a c"), (2, None), (3, ""), (4, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("embed_column", "hash_embedding"):
        df = QUERIES[name](spark, str(tmp_path))
        top = _above_generator(df)
        assert "aggregate(" not in top and "encode(" not in top and "Eval" not in top
    counts = {i: R.hash_counts([t or ""])[0] for i, t in rows}
    got = {(r["doc_id"], r["bucket"]): (r["weight"], r["length"]) for r in QUERIES["embed_column"](spark, str(tmp_path)).collect()}
    assert got == {(i, b): (int(v[b]), 1.0) for i, v in counts.items() for b in np.flatnonzero(v)}
    got = {(r["doc_id"], r["bucket"]): r["weight"] for r in QUERIES["hash_embedding"](spark, str(tmp_path)).collect()}
    assert got == {(i, b): round(float(v[b]) / float((v * v).sum()) ** 0.5, 6) for i, v in counts.items() for b in np.flatnonzero(v)}


def test_token_rows_of_no_term_are_not_kept(spark):
    docs = spark.createDataFrame(overlap_rows(50), "id long, tokens array<string>")
    table = spark.createDataFrame([("j", "word3", "word3", 1)], "jd_id string, term string, token string, n_tokens int")
    dealt, _ = R.dealt_tokens(docs, "id", F.col("tokens"), table, 1000, 20)
    assert [r.token for r in dealt.select("token").distinct().collect()] == ["word3"] and dealt.count() == 7
    assert "Generate" not in dealt._jdf.queryExecution().optimizedPlan().toString()  # texts are not read again
