"""Row-wise operators against plain brute-force readings of their contracts."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import compare

from rankloom.llm import bpe, licenses, pii, quality_model, quality_rules, secret_scan
from rankloom.llm.registry import vocabulary_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)).encode()).hexdigest()


# ------------------------------------------------------------------ quality rules


def brute_rules(row):
    text = row.text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    n = len(words)
    out = {
        "doc_id": row.doc_id, "n_words": n, "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }
    return out


BASE10 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules(nasty, small, empty):
    for docs in (nasty, small):
        report = quality_rules.report(docs)
        compare(report, BASE10, brute_rules, docs)
        assert report.where("base_failed and kept").count() == 0
    assert quality_rules.report(empty).count() == 0


def test_order_never_changes_the_verdict(nasty):
    a = quality_rules.report(nasty, list(quality_rules.RULES)).select("doc_id", "kept")
    b = quality_rules.report(nasty, list(quality_rules.RULES)[::-1]).select("doc_id", "kept")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    reports = [sorted(map(repr, quality_rules.report(nasty, order).collect())) for order in (None, list(quality_rules.RULES), list(quality_rules.RULES)[::-1])]
    assert reports[0] == reports[1] == reports[2]  # the cascade's order changes nothing
    assert sorted(quality_rules.rule_order(nasty)) == sorted(quality_rules.RULES)


# ------------------------------------------------------------------ secrets


def brute_secrets(row):
    text, spans = row.text or "", []
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans += [(m.start(), 0, "assign", m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    n = [sum(s[1] == k for s in spans) for k in range(3)]
    return {"doc_id": row.doc_id, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": sha(spans)}


def test_secrets(nasty, small, empty):
    for docs in (nasty, small):
        compare(secret_scan.scan(docs), ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), brute_secrets, docs)
    assert secret_scan.scan(empty).count() == 0


def test_entropy_windows():
    text = "0a9f3c7e1b5d8246ffee" * 2
    windows = [text[i : i + 20] for i in range(len(text) - 19)]
    entropy = lambda w: -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))
    assert secret_scan.best_entropy(text, 20) == pytest.approx(max(map(entropy, windows)))
    assert secret_scan.is_secret("aZ3kP9xQ7mT2vL8nR4wY6bC1")
    for plain in ("internationalisation_of_words", "2024-01-01-2024-01-02-03", "abcabcabcabcabcabcabcabc1", "chapter-and-verse-number-2024"):
        assert not secret_scan.is_secret(plain)
    assert secret_scan.redact("x password=abcdefgh12 y") == "x [SECRET] y"


# ------------------------------------------------------------------ personal data


def brute_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_pii(row):
    text, spans = row.text or "", []
    spans += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and brute_luhn(d):
            spans.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    n = [sum(s[1] == k for s in spans) for k in range(4)]
    return {"doc_id": row.doc_id, "n_email": n[0], "n_ip": n[1], "n_card": n[2], "n_phone": n[3], "base_sha256": sha(spans)}


BASE3 = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_personal_data(nasty, small, empty):
    short = nasty.where("length(text) is null or length(text) < 60000")  # the plain patterns are quadratic
    for docs in (short, small):
        compare(pii.scan(docs, pii.fit(small)), BASE3, brute_pii, docs)
    assert pii.scan(nasty).count() == nasty.count()
    assert pii.scan(empty).count() == 0


def test_skip_chain_finds_a_repeated_number(spark, small):
    texts = ["Call +1 (555) 010-9999 now. " + "word " * 40 + "Again: (555) 010-9999 thanks", "no data 12 here 2024"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    spans = {r.doc_id: r.spans for r in pii.scan(docs, field).collect()}
    assert spans[0].count("phone:") == 2 and spans[1] == ""


def test_all_of_fifty_repeats_are_found(spark):
    text = "Call +1 (555) 010-9999 now. " + "".join("word " * 20 + "again: (555) 010-9999 thanks " for _ in range(50))
    docs = spark.createDataFrame([(0, text), (1, "no data 12 here 2024")], "doc_id long, text string")
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    spans = {r.doc_id: r.spans for r in pii.scan(docs, field).collect()}
    assert spans[0].count("phone:") == 51 and spans[1] == ""


def test_field_is_learned_from_all_rows_in_any_order(spark):
    plain = [(i, f"year {1000 + i} and item {i} here") for i in range(9000)]
    rows = plain + [(9000 + i, f"mail a{i}@example.com from 10.0.{i % 200}.7 " + "7 " * 500 + "+1 (555) 010-9999") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = pii.fit(docs.coalesce(1)), pii.fit(docs.orderBy(F.desc("doc_id")).repartition(7))
    for x, y in ((a.weights, b.weights), (a.chain, b.chain), (a.skip, b.skip)):
        assert np.array_equal(x, y)
    shape = a.weights[1 + pii.shape("a1@example.com")]  # a kind of the last rows only is known
    assert shape.argmax() == 1
    assert a.weights[1 + pii.shape("+1")].argmax() == 4  # as is one beyond a text's first 400 tokens


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(1)
    k, n = len(pii.LABELS), 4
    field = pii.Field(rng.normal(size=(pii.WIDTH, k)), rng.normal(size=(k, k)), np.zeros((k, k)))
    graph = pii.graph_of("+1 22 (333) 4444")
    assert len(graph.tokens) == n and len(graph.chain) == n - 1
    got = pii.marginals([graph], field)[0]
    unary = field.weights[graph.feats].sum(1)
    joint = np.zeros((k,) * n)
    for y in np.ndindex(*joint.shape):
        joint[y] = sum(unary[i, y[i]] for i in range(n)) + sum(field.chain[y[i], y[i + 1]] for i in range(n - 1))
    joint = np.exp(joint - joint.max())
    want = np.stack([joint.sum(tuple(j for j in range(n) if j != i)) for i in range(n)])
    assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 0.02  # damping leaves a little after the rounds


# ------------------------------------------------------------------ byte-pair encoding


def test_bpe_equals_the_library(nasty, small, empty):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def brute(row):
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        return {
            "doc_id": row.doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            "decoded_sha256": hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        }

    for docs in (nasty, small):
        compare(bpe.digests(docs, path), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), brute, docs)
    assert bpe.digests(empty, path).count() == 0
    assert bpe.encode_documents(nasty, path).columns == ["doc_id", "ids", "decoded"]


# ------------------------------------------------------------------ licences


def brute_licenses(row):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), row.text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return {
        "doc_id": row.doc_id, "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)),
    }


def test_licenses_read_the_texts_once_for_phrases_and_notices(nasty):
    plan = licenses.scan(nasty)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # the words' count and the matches


def test_licenses(nasty, small, empty):
    for docs in (nasty, small):
        out = licenses.scan(docs)
        compare(out, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), brute_licenses, docs)
        assert out.where("score < 0 or score > 1").count() == 0
    assert licenses.scan(empty).count() == 0


def test_notice_with_a_changed_word(nasty):
    found = {r.doc_id: r for r in licenses.scan(nasty).where("labels != ''").collect()}
    texts = {r.doc_id: r.text or "" for r in nasty.collect()}
    changed = next(i for i, t in texts.items() if t.startswith("This program is free software: you can redistribute it and maybe"))
    assert "gpl" in found[changed].labels.split(",")
    full = next(i for i, t in texts.items() if t.startswith("This work is licensed under the GNU"))
    assert {"gpl", "gpl-3", "reserved"} <= set(found[full].labels.split(",")) and found[full].score == 1.0


# ------------------------------------------------------------------ quality model


def test_quality_model(spark, nasty, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_model.fit(docs, labels)
    held = quality_model.score(docs, machine).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    out = quality_model.score(nasty, machine)
    assert out.count() == nasty.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_model.score(empty, machine).count() == 0
    blank = quality_model.score(nasty, quality_model.fit(empty, labels))
    assert {r.score for r in blank.collect()} == {0.5}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_model.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)) / 4)
    index, x = np.arange(0, 30, 3), rng.normal(size=10)
    pairs = sum((m.factors[a] @ m.factors[b]) * x[i] * x[j] for i, a in enumerate(index) for j, b in enumerate(index) if i < j)
    assert m.score(index, x) == pytest.approx(1 / (1 + np.exp(-(0.1 + m.linear[index] @ x + pairs))))
