"""Queries for the text and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.functions import json_text as J
from rankloom.functions import numeric as N
from rankloom.functions import text as X
from rankloom.jobs import compiled, literal_sql
from rankloom.operators import features
from rankloom.operators.profile import deep_duration_months, months_total
from rankloom.plans import oracle as O
from rankloom.plans.fixtures import JD_STAR
from rankloom.plans.queries.registry import (
    candidates_json,
    documents,
    documents_scored,
    joined,
    profiles,
    query,
    r6,
    table,
    with_tokens,
)
from pyspark.sql import types as T

DOC_TERMS = ["thtion", "  Attion ", "eriner nicht", "", "the", "zzzz the", "Le la"]
TERM_SETS = [["thtion"], ["attion", "the"], ["eriner", "nicht"], ["le", "la", "les"], ["zzzz"]]
ROLE = ["the", "nicht", "zzzz", "eriner"]


def _terms(items) -> F.Column:
    return F.expr(literal_sql(items, T.DataType.fromDDL("array<array<string>>")))


@query(
    "tokens",
    f"SELECT doc_id, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, {O.toks('text')} AS t FROM documents)",
)
def _(spark, sf):
    t = X.tokens(F.col("text"))
    docs = documents(spark, sf).select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), joined(F.array_sort("t"), " ").alias("tokens"))


@query(
    "signal_tokens",
    f"SELECT doc_id, array_to_string(list_sort({O.sig('text')}), ' ') AS kept, len({O.sig('text', O.GENERIC)}) AS n_focus FROM documents",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id",
        joined(F.array_sort(X.signal_tokens(F.col("t"))), " ").alias("kept"),
        F.size(X.signal_tokens(F.col("t"), drop_generic=True)).alias("n_focus"),
    )


_OVERLAP = f"""WITH d AS (SELECT doc_id, lower(text) AS low, {O.toks('text')} AS tk,
  list_filter({O._list(DOC_TERMS)}, lambda x: trim(x) <> '') AS terms FROM documents),
m AS (SELECT doc_id, terms, list_filter(terms, lambda x: contains(low, lower(trim(x))) OR
  (len({O.toks('x')}) > 0 AND len(list_intersect({O.toks('x')}, tk)) = len({O.toks('x')}))) AS hit FROM d)
SELECT doc_id, array_to_string(hit, '|') AS matched, array_to_string(list_filter(terms, lambda y: NOT list_contains(hit, y)), '|') AS missing FROM m"""


@query("skill_overlap", _OVERLAP)
def _(spark, sf):
    docs = documents(spark, sf).select(
        "doc_id", X.tokens(F.col("text")).alias("tk"), F.lower("text").alias("low")
    )
    given = F.filter(X.words(DOC_TERMS), lambda t: F.trim(t) != "")
    terms = F.transform(
        given, lambda t: F.struct(t.alias("term"), F.lower(F.trim(t)).alias("lowered"), X.tokens(t).alias("words"))
    )
    rows = docs.select("doc_id", X.present_terms(F.col("low"), F.col("tk"), terms).alias("hit"))
    matched = F.transform("hit", lambda t: t["term"])
    return rows.select("doc_id", joined(matched).alias("matched"), joined(F.array_except(given, matched)).alias("missing"))


@query(
    "clean_terms",
    """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda y: y <> '') AS t FROM documents),
k AS (SELECT doc_id, t, list_transform(t, lambda z: lower(z)) AS keys FROM d)
SELECT doc_id, len(c) AS n_terms, array_to_string(c, '|') AS terms FROM (SELECT doc_id, list_filter(t, lambda v, i: list_position(keys, lower(v)) = i) AS c FROM k)""",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", X.clean_terms(F.split("text", "\n")).alias("c"))
    return docs.select("doc_id", F.size("c").alias("n_terms"), joined("c").alias("terms"))


_SKILL_TEXT_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'Strong ' WHEN 1 THEN ' expert  ' WHEN 2 THEN '' ELSE 'Strongly ' END || p_name || ' Systems / ' || p_type || ' with ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' hands-on Experience' ELSE '' END"


def _skill_text():
    k = F.col("p_partkey")
    lead = F.when(k % 4 == 0, "Strong ").when(k % 4 == 1, " expert  ").when(k % 4 == 2, "").otherwise("Strongly ")
    tail = F.when(k % 3 == 0, " hands-on Experience").otherwise("")
    return F.concat(lead, F.col("p_name"), F.lit(" Systems / "), F.col("p_type"), F.lit(" with "), F.col("p_brand"), tail)


@query("skill_label", f"SELECT p_partkey, {O._label(_SKILL_TEXT_SQL)} AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.skill_label(_skill_text()).alias("label"))


@query("canonical_skill", f"SELECT p_partkey, {O.canonical('(' + _SKILL_TEXT_SQL + ')')} AS skill FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.canonical_skill(_skill_text()).alias("skill"))


@query(
    "ai_skill_flag",
    f"SELECT conv_id, turn, {O.contains_any('lower(text)', C.AI_KEYWORDS)} AS is_ai FROM conversations",
)
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.is_ai_skill(F.col("text")).alias("is_ai"))


@query(
    "metric_mentions",
    O.on_candidates(f"SELECT candidate_id, {O.count_of('lower(text)', O.METRICS)} AS n_mentions FROM prof", "prof"),
)
def _(spark, sf):
    return profiles(spark, sf).select("candidate_id", X.metric_mentions(F.lower("text")).cast("long").alias("n_mentions"))


@query(
    "term_occurrences",
    O.on_candidates(
        "SELECT candidate_id, "
        + ", ".join(f"{O.count_of('lower(text)', w)} AS n_{w}" for w in ["expert", "guru", "rockstar"])
        + " FROM prof",
        "prof",
    ),
)
def _(spark, sf):
    low = F.lower("text")
    return profiles(spark, sf).select(
        "candidate_id", *[X.occurrences(low, w).cast("long").alias(f"n_{w}") for w in C.PROMOTIONAL_WORDS]
    )


@query(
    "strip_code_fence",
    """SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS body FROM conversations""",
)
def _(spark, sf):
    fenced = F.when(
        F.col("turn") % 2 == 0, F.concat(F.lit(" ```json\n"), F.col("text"), F.lit("\n```\n"))
    ).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(X.strip_code_fence(fenced)).alias("body")
    )


@query(
    "truncate_text",
    "SELECT doc_id, length(left(text, 24000)) AS n_kept, md5(left(text, 24000)) AS digest FROM documents",
)
def _(spark, sf):
    cut = X.truncate_text(F.col("text"))
    return documents(spark, sf).select("doc_id", F.length(cut).alias("n_kept"), F.md5(cut).alias("digest"))


@query(
    "normalize_text",
    O.on_candidates("SELECT key, length(text) AS n_chars, text FROM prof", "prof"),
)
def _(spark, sf):
    text = J.json_text(F.col("raw"))
    return candidates_json(spark, sf).select("key", F.length(text).alias("n_chars"), text.alias("text"))


@query(
    "normalize_props",
    "SELECT event_id, json_extract_string(props, '$.k') AS text FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", J.json_text(F.col("props")).alias("text"))


@query(
    "coerce_number",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CASE event_id % 6 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN CAST(event_id AS DOUBLE) * 100 WHEN 3 THEN CAST('1' || event_id AS DOUBLE) ELSE NULL END AS from_text
FROM events""",
)
def _(spark, sf):
    n, m = F.col("event_id").cast("string"), F.col("event_id") % 6
    spoken = (
        F.when(m == 0, F.concat(F.lit(" \t"), n, F.lit(".0 ")))
        .when(m == 1, F.concat(n, F.lit("d")))
        .when(m == 2, F.concat(F.lit("+"), n, F.lit("e2")))
        .when(m == 3, F.concat(F.lit("1_"), n))
        .when(m == 4, F.lit("true"))
        .otherwise(F.col("event_type"))
    )
    k = J.variant_number(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    return table(spark, sf, "events").select("event_id", k.alias("k"), N.number_from_text(spoken).alias("from_text"))


@query(
    "deep_key_values",
    O.on_candidates(
        """SELECT key, len(skills) + len(history) AS n_values,
  list_sum(list_concat(list_transform(skills, lambda a: a.duration_months::DOUBLE), list_transform(history, lambda b: b.duration_months::DOUBLE))) AS total
FROM cand""",
        "cand",
    ),
)
def _(spark, sf):
    found = candidates_json(spark, sf).select("key", deep_duration_months(F.col("raw")).alias("v"))
    return found.select("key", F.size("v").alias("n_values"), months_total(F.col("v")).alias("total"))


@query(
    "clamp",
    "SELECT event_id, round(greatest(0.0, least(1.0, value / 50 - 0.1)), 6) AS clamped FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(N.clamp(F.col("value") / 50 - 0.1)).alias("clamped"))


@query(
    "soft_cap",
    "SELECT event_id, round(1 - exp(-greatest(value - 5, 0) / 40.0), 6) AS capped, 0.0::DOUBLE AS no_scale FROM events",
)
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r6(N.soft_cap(v - 5, 40.0)).alias("capped"), N.soft_cap(v, 0.0).alias("no_scale")
    )


@query(
    "mean_score",
    "SELECT event_id, round(least(1.0, (value / 20 + event_id % 3 + 0.5) / 3), 6) AS mean, 0.0::DOUBLE AS of_nothing FROM events",
)
def _(spark, sf):
    values = F.array(F.col("value") / 20, (F.col("event_id") % 3).cast("double"), F.lit(0.5))
    return table(spark, sf, "events").select(
        "event_id",
        r6(N.mean_score(values)).alias("mean"),
        N.mean_score(F.array().cast("array<double>")).alias("of_nothing"),
    )


@query(
    "semantic_rescale",
    """SELECT vec_id, round(CASE WHEN x BETWEEN -1 AND 1 THEN greatest(0.0, least(1.0, (x + 1) / 2)) ELSE greatest(0.0, least(1.0, x)) END, 6) AS score
FROM (SELECT vec_id, embedding[1]::DOUBLE * 6 AS x FROM embeddings)""",
)
def _(spark, sf):
    x = F.get("embedding", F.lit(0)).cast("double") * 6
    return table(spark, sf, "embeddings").select("vec_id", r6(N.semantic_rescale(x)).alias("score"))


_SETS_SQL = "[" + ", ".join(O._list(s) for s in TERM_SETS) + "]"


@query(
    "keyword_density",
    f"SELECT doc_id, round({O.dens('s')}, 6) AS density FROM (SELECT doc_id, {O.dens_scores(_SETS_SQL, O.toks('text'))} AS s FROM documents)",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", r6(X.keyword_density(F.col("t"), _terms(TERM_SETS))).alias("density"))


@query(
    "token_set_ops",
    f"""SELECT doc_id, len(list_intersect(t, r)) AS n_both, len(list_distinct(list_concat(t, r))) AS n_any,
  len(list_filter(r, lambda x: NOT list_contains(t, x))) AS n_absent FROM (SELECT doc_id, {O.toks('text')} AS t, {O._list(ROLE)} AS r FROM documents)""",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("t"))
    role = X.words(ROLE)
    return docs.select(
        "doc_id",
        F.size(F.array_intersect("t", role)).alias("n_both"),
        F.size(F.array_union("t", role)).alias("n_any"),
        F.size(F.array_except(role, F.col("t"))).alias("n_absent"),
    )


@query(
    "record_filters",
    """WITH r AS (SELECT 'events' AS source, props AS raw FROM events UNION ALL SELECT 'conversations', text FROM conversations
  UNION ALL SELECT 'lines', unnest(string_split(text, chr(10))) FROM documents)
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE trim(raw) = '') AS n_blank,
  count(*) FILTER (WHERE json_valid(raw) AND starts_with(trim(raw), '{')) AS n_objects FROM r GROUP BY source""",
)
def _(spark, sf):
    from rankloom.sources.readers import BLANK, is_object

    rows = (
        table(spark, sf, "events").select(F.lit("events").alias("source"), F.col("props").alias("raw"))
        .unionAll(table(spark, sf, "conversations").select(F.lit("conversations"), "text"))
        .unionAll(documents(spark, sf).select(F.lit("lines"), F.explode(F.split("text", "\n"))))
    )
    good = F.try_parse_json("raw").isNotNull() & is_object(F.col("raw"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("raw").rlike(BLANK)).alias("n_blank"),
        F.count_if(good).alias("n_objects"),
    )


# documents as records: every default branch of the features, and the long-form reason


def _doc(name: str, sql: str, upto: str = "scored"):
    return query(name, O.on_documents(sql, upto))


@_doc("lexical_relevance", "SELECT candidate_id, round(lexical_relevance, 6) AS lexical_relevance FROM scored")
def _(spark, sf):
    return documents_scored(spark, sf).select("candidate_id", r6("lexical_relevance").alias("lexical_relevance"))


@_doc("lexical_retrieval", "SELECT candidate_id, round(retrieval, 6) AS retrieval, round(semantic_match, 6) AS semantic FROM scored")
def _(spark, sf):
    return documents_scored(spark, sf).select(
        "candidate_id", r6("retrieval").alias("retrieval"), r6("semantic_match").alias("semantic")
    )


@_doc("document_integrity", "SELECT candidate_id, round(integrity_score, 6) AS integrity, array_to_string(integrity_flags, '|') AS flags FROM scored")
def _(spark, sf):
    return documents_scored(spark, sf).select(
        "candidate_id", r6("integrity_score").alias("integrity"), joined("integrity_flags").alias("flags")
    )


@query(
    "integrity",
    O.on_candidates("SELECT DISTINCT candidate_id, round(integrity_score, 6) AS integrity, array_to_string(integrity_flags, '|') AS flags FROM scored", "scored"),
)
def _(spark, sf):
    df = with_tokens(spark, sf)
    flags = features.integrity_flags(
        F.col("text"), F.col("lowered"), F.col("n_tokens"), F.col("signals")["completeness"], F.col("experience_text")
    )
    df = df.select("candidate_id", "n_tokens", flags.alias("f"))
    score = features.integrity_score(F.col("f"), F.col("n_tokens"))
    return df.select("candidate_id", r6(score).alias("integrity"), joined("f").alias("flags"))


@query(
    "production_score",
    O.on_candidates("SELECT candidate_id, round(production_score, 6) AS production FROM scored WHERE jd_id = 'star'", "scored"),
)
def _(spark, sf):
    jd = F.expr(literal_sql(compiled(JD_STAR)["production"], T.DataType.fromDDL("array<array<string>>")))
    df = with_tokens(spark, sf)
    measured = F.least(F.lit(1.0), X.metric_mentions(F.col("lowered")) / 5)
    score = N.clamp(0.78 * X.keyword_density(F.col("tokens"), jd) + 0.22 * measured)
    return df.select("candidate_id", r6(score).alias("production"))


