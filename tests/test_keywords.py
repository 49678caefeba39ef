"""Keyword automaton against plain substring tests."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators.keywords import keyword_blocks, keyword_contains_join

NASTY = [None, "", "a", "aa", "aaaa", "Straße 7", "STRASSE", "\U0001f600x\U0001f600", "ab\nab", "x" * 50_000 + "needle", "a"]
WORDS = ["a", "aa", "aaa", "ß", "\U0001f600", "\U0001f600x", "b\na", "needle", "x" * 40, "zz", "", None, "a"]


def brute(texts, words):
    words = {w for w in words if w is not None}
    return sorted((i, w) for i, t in enumerate(texts) if t is not None for w in words if w in t)


def found(df):
    return sorted((r.i, r.keyword) for r in df.collect())


def test_unusual_texts_and_keywords(spark):
    texts = spark.createDataFrame(list(enumerate(NASTY)), "i int, text string")
    want = brute(NASTY, WORDS)
    assert found(keyword_contains_join(texts, "text", WORDS, ["i"])) == want
    table = spark.createDataFrame([(w,) for w in WORDS], "word string")
    assert found(keyword_contains_join(texts, F.col("text"), table, ["i"])) == want
    assert found(keyword_contains_join(texts, "text", table, ["i"], max_bytes=8)) == want  # several blocks


def test_many_keywords_in_one_pass(spark):
    pick = random.Random(5)
    words = sorted({"".join(pick.choices("abcdef", k=pick.randint(2, 6))) for _ in range(10_000)})
    texts = ["".join(pick.choices("abcdef ", k=pick.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    out = keyword_contains_join(df, "text", words, ["i"])
    assert found(out) == brute(texts, words)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Generate" not in plan


def test_repeated_rows_other_columns_and_empty_inputs(spark):
    rows = spark.createDataFrame([(1, "ab", [1.5, None]), (1, "ab", [1.5, None]), (None, "b", None)], "i int, text string, v array<double>")
    out = keyword_contains_join(rows, "text", ["b"], ["i", "v"]).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, [1.5, None], "b")] * 2 + [(None, None, "b")], key=repr)
    assert keyword_contains_join(rows, "text", [], ["i"]).count() == 0
    assert keyword_contains_join(rows.where("false"), "text", ["b"], ["i"]).count() == 0
    assert keyword_contains_join(rows, "text", [None, ""], ["i"]).count() == 3
    with pytest.raises(ValueError, match="taken"):
        keyword_contains_join(rows.withColumnRenamed("i", "keyword"), "text", ["b"], ["keyword"])


def test_blocks_are_bounded():
    blocks = list(keyword_blocks([f"w{i:04d}" for i in range(100)] + ["x" * 500], 60))
    assert sum(map(len, blocks)) == 101
    assert all(len(b) == 1 or sum(len(w) + 1 for w in b) <= 60 for b in blocks)


def test_lists_hold_the_same_keywords_in_one_row_a_text(spark):
    texts = spark.createDataFrame(list(enumerate(NASTY)) + [(4, "aaaa")], "i int, text string")
    for words in (WORDS, [w for w in WORDS if w], [None], []):
        flat = found(keyword_contains_join(texts, "text", words, ["i"]))
        rows = keyword_contains_join(texts, "text", words, ["i"], lists=True).collect()
        assert sorted((r.i, w) for r in rows for w in r.keyword) == flat
        assert len(rows) <= texts.count() and all(r.keyword for r in rows)
