"""Queries for vector retrieval and relational term matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.jobs import compiled
from rankloom.operators import retrieval as R
from rankloom.operators.keywords import keyword_contains_join
from rankloom.plans import oracle as O
from rankloom.plans.fixtures import JD_DOC
from rankloom.plans.queries.registry import documents, documents_scored, query, r6, table

QUERY_TEXT = "eriner nicht thtion attion ering the le la"
KEYWORDS = ["ring", "old", "hot", "gear", "zzz"]

_WEIGHTS = """w_tok AS (SELECT {key} AS doc, sha256(token) AS h FROM (SELECT {key}, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM {table}) WHERE token <> ''),
w AS (SELECT doc, CAST('0x' || substr(h, 1, 4) AS INTEGER) % 384 AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 6, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS weight
  FROM w_tok GROUP BY ALL HAVING weight <> 0),
n AS (SELECT doc, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc)"""


def _weights(key: str, name: str, prefix: str = "") -> str:
    sql = _WEIGHTS.format(key=key, table=name)
    for part in ("w_tok", "w", "n"):
        sql = sql.replace(f"{part} AS (", f"{prefix}{part} AS (", 1).replace(f"FROM {part} ", f"FROM {prefix}{part} ")
    return sql


_DOCS = _weights("doc_id", "documents")


@query(
    "hash_embedding",
    f"WITH {_DOCS} SELECT w.doc AS doc_id, bucket, round(weight / norm, 6) AS weight FROM w JOIN n ON w.doc = n.doc",
)
def _(spark, sf):
    vectors = R.hash_buckets(documents(spark, sf), "doc_id", "text")
    return vectors.select("doc_id", "bucket", r6(F.col("weight") / F.col("norm")).alias("weight"))


@query("norm_of_vector", f"WITH {_DOCS} SELECT doc AS doc_id, round(norm, 6) AS norm FROM n")
def _(spark, sf):
    return R.vector_norms(documents(spark, sf), "doc_id", "text").select("doc_id", r6("norm").alias("norm"))


@query(
    "embed_column",
    f"WITH {_DOCS} SELECT w.doc AS doc_id, bucket, CAST(weight AS INTEGER) AS weight, 1.0::DOUBLE AS length FROM w",
)
def _(spark, sf):
    """Every weight by a caller's encoder (plain counts, so exact), and the length of the default encoder's vectors."""
    unit = F.aggregate(R.embed_column(F.col("text")), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # both vectors are computed below the generator, else every entry of one computes the other again
    both = documents(spark, sf).select("doc_id", F.round(F.sqrt(unit), 5).alias("length"), R.embed_column(F.col("text"), R.load_hash_counts).alias("_v"))
    docs = both.select("doc_id", "length", F.posexplode("_v").alias("bucket", "x"))
    return docs.where("x <> 0").select("doc_id", "bucket", F.col("x").cast("int").alias("weight"), "length")


@query(
    "cosine_sparse",
    f"""WITH {_DOCS}, q_in AS (SELECT 0 AS q_id, '{QUERY_TEXT}' AS text), {_weights('q_id', 'q_in', 'q_')}
SELECT d.doc_id, round(coalesce(s.score, 0), 6) AS score FROM documents d LEFT JOIN (
  SELECT w.doc, sum(w.weight / n.norm * q_w.weight / q_n.norm) AS score FROM w JOIN n ON n.doc = w.doc JOIN q_w ON q_w.bucket = w.bucket JOIN q_n ON q_n.doc = q_w.doc GROUP BY w.doc) s
  ON s.doc = d.doc_id""",
)
def _(spark, sf):
    wanted = R.hash_vectors([QUERY_TEXT]).astype("float64")[0]
    wanted = wanted / (wanted @ wanted) ** 0.5
    return R.cosine_sparse(documents(spark, sf), "doc_id", "text", wanted.tolist()).withColumn("score", r6("score"))


@query(
    "retrieve_topk",
    f"""WITH {_DOCS}, {_weights('item_id', 'benchmark', 'q_')},
s AS (SELECT q_w.doc AS query_id, w.doc AS doc_id, sum(w.weight / n.norm * q_w.weight / q_n.norm) AS score
  FROM w JOIN n ON n.doc = w.doc JOIN q_w ON q_w.bucket = w.bucket JOIN q_n ON q_n.doc = q_w.doc GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS place FROM s) WHERE place <= 5""",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    vector = R.embed_column(F.col("text"), R.load_hash_counts)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = R.retrieve(docs, vector, queries, 5, row_id="doc_id", query_vector=vector, cosine=True, digits=5)
    return found.select("query_id", "doc_id", r6("score").alias("score"))


_CENTROIDS = "c AS (SELECT label AS query_id, [" + ", ".join(
    f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(64)
) + "] AS q FROM embeddings GROUP BY label)"


def _nearest_sql(k: int) -> str:
    return f"""WITH {_CENTROIDS}, s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2])) AS score FROM embeddings CROSS JOIN c)
SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, vec_id) AS place FROM s) WHERE place <= {k}"""


def _nearest(spark, sf, k: int):
    rows = table(spark, sf, "embeddings")
    mean = F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)])
    queries = rows.groupBy(F.col("label").alias("query_id")).agg(mean.alias("q"))  # a table of one vector per label
    found = R.retrieve(rows, F.col("embedding"), queries, k, row_id="vec_id", query_vector=F.col("q"), digits=8)
    return found.select("query_id", "vec_id", r6("score").alias("score"))


@query("inner_product_topk", _nearest_sql(20))
def _(spark, sf):
    return _nearest(spark, sf, 20)


@query("inner_product_top5000", _nearest_sql(5000))
def _(spark, sf):
    """As many rows per query as the funnel's first cut keeps."""
    return _nearest(spark, sf, 5000)


@query(
    "inner_product_single",
    f"""WITH c AS (SELECT [{", ".join(f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(64))}] AS q FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2])) AS score FROM embeddings CROSS JOIN c)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 50""",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    mean = rows.agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("q"))
    found = R.retrieve_one(rows.select("vec_id", "embedding"), F.col("embedding"), mean.first()["q"], 50, row_id="vec_id")
    return found.select("vec_id", r6("retrieval_score").alias("score"))


@query(
    "attach_retrieval_score",
    O.on_documents(
        """SELECT s.candidate_id, round(coalesce(l.quality::DOUBLE, s.retrieval), 6) AS retrieval,
  round(CASE WHEN l.quality IS NULL THEN s.semantic_match ELSE (l.quality + 1) / 2.0 END, 6) AS semantic
FROM scored s LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.candidate_id""",
        "scored",
    ),
)
def _(spark, sf):
    from rankloom.functions.numeric import semantic_rescale
    from rankloom.operators.features import attach_retrieval_score

    given = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("candidate_id"), F.col("quality").alias("retrieval_score")
    )
    rows = documents_scored(spark, sf).select("candidate_id", "lexical_relevance").join(given, "candidate_id", "left")
    score = attach_retrieval_score(rows)
    return rows.select("candidate_id", r6(score).alias("retrieval"), r6(semantic_rescale(score)).alias("semantic"))


_TERMS = [t for t in compiled(JD_DOC)["lexical"]] + [["the", "le", "nicht"]]


@query(
    "token_overlap_join",
    "WITH t(term, tokens) AS (VALUES "
    + ", ".join(f"('{' '.join(t)}', {O._list(t)})" for t in _TERMS)
    + f"""), d AS (SELECT doc_id, {O.toks('text')} AS tk FROM documents)
SELECT doc_id, 'doc' AS jd_id, term, round(len(list_intersect(tokens, tk))::DOUBLE / len(tokens), 6) AS coverage FROM d CROSS JOIN t WHERE len(list_intersect(tokens, tk)) > 0""",
)
def _(spark, sf):
    terms = spark.createDataFrame(
        [("doc", " ".join(t), w, len(t)) for t in _TERMS for w in t], "jd_id string, term string, token string, n_tokens int"
    )
    docs = documents(spark, sf)
    found = R.token_overlap_join(docs, "doc_id", X.tokens(F.col("text")), terms)
    return found.select("doc_id", "jd_id", "term", r6("coverage").alias("coverage"))


@query(
    "keyword_contains_join",
    f"SELECT p_partkey, k AS keyword FROM part CROSS JOIN (SELECT unnest({O._list(KEYWORDS)}) AS k) WHERE contains(p_name, k)",
)
def _(spark, sf):
    return keyword_contains_join(table(spark, sf, "part"), "p_name", KEYWORDS, ["p_partkey"])


# letter triples of all benchmark texts: some thousand keywords, a table
_TRIPLES = "SELECT DISTINCT unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS keyword FROM benchmark"


@query(
    "keyword_contains_many",
    f"""WITH k AS ({_TRIPLES})
SELECT doc_id, count(*) AS n_keywords, min(keyword) AS first_keyword, max(keyword) AS last_keyword FROM documents JOIN k ON contains(text, keyword) GROUP BY doc_id""",
)
def _(spark, sf):
    """Thousands of keywords, taken from one table, in all texts of another."""
    last = F.length("text") - 2
    starts = table(spark, sf, "benchmark").where(last >= 1).select("text", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    triples = starts.select(F.substring("text", F.col("i"), F.lit(3)).alias("keyword")).distinct()
    # one row a text leaves the tasks, not one a keyword
    found = keyword_contains_join(documents(spark, sf), "text", triples, ["doc_id"], lists=True)
    return found.groupBy("doc_id").agg(
        F.sum(F.size("keyword")).alias("n_keywords"), F.min(F.array_min("keyword")).alias("first_keyword"), F.max(F.array_max("keyword")).alias("last_keyword")
    )
