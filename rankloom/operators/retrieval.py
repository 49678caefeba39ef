"""Exact vector retrieval: hashed-token vectors, dense inner products, top-K."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from rankloom import constants as C
from rankloom.functions.numeric import once
from rankloom.operators import topk
from rankloom.session import shared_dir

SPACES = r"(?U)[\s\x1c-\x1f]+"
SPARSE = "array<struct<bucket:int,weight:double>>"
DIMS = C.EMBEDDING_DIMS  # a plain number: tasks need no copy of the constants
MAX_QUERY_VALUES = 1_000_000  # numbers in one block of queries (8 MB)

Encoder = Callable[[list[str]], np.ndarray]

# the batch functions below travel with the plan, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------------------
# hashed-token vectors
# ---------------------------------------------------------------------------


def sparse_vector(text: Column, dims: int = DIMS) -> Column:
    """Hashed-token vector of a text as ``array<struct<bucket, weight>>`` without zeros; one projection, no shuffle.

    Bucket and sign come from the SHA-256 of each white-space token; weights are whole numbers.  Only
    what is not zero leaves the Python task.
    """

    @F.arrow_udf(SPARSE)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = Places(dims)
        for batch in batches:
            counts = hash_counts([x or "" for x in batch.to_pylist()], dims, places)
            row, bucket = np.nonzero(counts)
            firsts = np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32)
            entries = [pa.array(bucket.astype(np.int32)), pa.array(counts[row, bucket].astype(np.float64))]
            yield pa.ListArray.from_arrays(pa.array(firsts), pa.StructArray.from_arrays(entries, ["bucket", "weight"]))

    return encode(text)


def sparse_norm(vector: Column) -> Column:
    """L2 norm of a sparse vector, of one row alone; whole squares, so exact in any order."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))


def hash_buckets(df: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """Sparse hashed-token vectors as rows: ``(key, bucket, weight, norm)``, zeros left out; nothing is shuffled."""
    vectors = df.select(key, sparse_vector(F.col(text), dims).alias("_v"))
    # the norm has a projection of its own below the generator, else every entry computes it again
    normed = vectors.select(key, "_v", sparse_norm(F.col("_v")).alias("norm"))
    return normed.select(key, "norm", F.inline("_v")).select(key, "bucket", "weight", "norm")


def vector_norms(df: DataFrame, key: str, text: str) -> DataFrame:
    """L2 norm of every text's vector; texts without tokens have none."""
    vectors = df.select(key, sparse_vector(F.col(text)).alias("_v")).where(F.size("_v") > 0)
    return vectors.select(key, sparse_norm(F.col("_v")).alias("norm"))


class Places(dict):
    """Token to twice its bucket, plus one for a negative sign; every token is hashed once per task."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        digest = hashlib.sha256(token.encode()).digest()
        place = self[token] = (digest[0] * 256 + digest[1]) % self.dims * 2 + (digest[2] & 1)
        return place


def hash_counts(texts: list[str], dims: int = DIMS, places: Places | None = None) -> np.ndarray:
    """Signed token counts per bucket for one Arrow batch; whole numbers, so exact."""
    places = Places(dims) if places is None else places
    out = np.zeros((len(texts), dims), dtype="float32")
    for row, text in enumerate(texts):
        signed = np.bincount([places[token] for token in text.lower().split()], minlength=2 * dims)
        out[row] = signed[0::2] - signed[1::2]
    return out


def load_hash_counts() -> Encoder:
    """Loader for ``embed_column`` that leaves the counts unscaled."""
    places = Places(DIMS)
    return lambda texts: hash_counts(texts, DIMS, places)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def hash_vectors(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Dense unit vectors of hashed tokens; zero stays zero."""
    return unit_rows(hash_counts(texts, dims))


def load_or_none(load: Callable[[], Encoder]) -> Callable[[], Encoder] | None:
    """``load`` if it works on the driver, else None (hashed vectors for the whole column)."""
    try:
        load()
    except (ImportError, OSError):
        return None
    return load


def embed_column(text: Column, load: Callable[[], Encoder] | None = None) -> Column:
    """Text to unit vectors by a user's batch encoder.

    ``load`` runs once per task and gives the encoder.  Where it is missing is decided once, here on
    the driver: then the whole column holds hashed-token vectors, as without ``load``.  A task where
    it fails stops the job, so a column never mixes two kinds of vectors.
    """
    load = load and load_or_none(load)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = hash_vectors if load is None else load()
        for batch in batches:
            vectors = np.asarray(encoder([x or "" for x in batch.to_pylist()]), dtype="float32")
            firsts = np.arange(len(batch) + 1, dtype=np.int32) * (vectors.shape[1] if len(batch) else 0)
            yield pa.ListArray.from_arrays(pa.array(firsts), pa.array(vectors.ravel()))

    return encode(text)


# ---------------------------------------------------------------------------
# scores
# ---------------------------------------------------------------------------


def inner_product(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision, in element order."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine_sparse(df: DataFrame, key: str, text: str, query: list[float]) -> DataFrame:
    """Cosine of every text's sparse vector with one unit query; every row is kept.

    The query is one literal array, looked up by bucket: a row-local sum without any shuffle.  Rows
    without a common bucket, or without any token, score 0.
    """
    wanted = F.lit([float(x) for x in query])

    def dot(vector: Column) -> Column:
        total = F.aggregate(vector, F.lit(0.0), lambda s, e: s + e["weight"] * F.get(wanted, e["bucket"]))
        return F.when(F.size(vector) > 0, total / sparse_norm(vector)).otherwise(F.lit(0.0))

    return df.select(key, once(sparse_vector(F.col(text)), dot).alias("score"))


def packed(df: DataFrame, key: str, vector: Column, rows: int, unit: bool) -> DataFrame:
    """Vectors in blocks of up to ``rows``: ``ids`` and ``matrix`` (doubles, row by row); null vectors are left out."""
    keyed = df.select(F.col(key).alias("id"), vector.alias("vec")).where(F.col("vec").isNotNull())
    target = pa.schema([("ids", pa.list_(to_arrow_type(df.schema[key].dataType))), ("matrix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block():
            matrix = np.stack(vectors)
            raw = (unit_rows(matrix) if unit else matrix).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], target[0].type), pa.array([raw], pa.binary())], schema=target)

        for batch in batches:
            for name, vec in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(name)
                vectors.append(vec.values.to_numpy(zero_copy_only=False).astype("float64"))
                if len(ids) == rows:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return keyed.mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(df.schema[key].dataType)), T.StructField("matrix", T.BinaryType())]))


class BestRows:
    """The best ``k`` rows of every query seen so far, equal scores by the smaller id."""

    def __init__(self, k: int, n: int):
        self.k = k
        self.found = [(np.empty(0), np.empty(0), np.empty(0, object)) for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, compared: np.ndarray) -> None:
        for j in np.flatnonzero(compared.max(axis=0) >= self.least):
            new = np.flatnonzero(compared[:, j] >= self.least[j])
            parts = (compared[new, j], scores[new, j], ids[new])
            order_by, score, rows = (np.concatenate(x) for x in zip(self.found[j], parts))
            best = np.lexsort((rows, -order_by))[: self.k]
            self.found[j] = order_by[best], score[best], rows[best]
            if len(best) == self.k:
                self.least[j] = order_by[best[-1]]


#: Queries of one block: their numbers, and the results a task holds for them.
MAX_HELD_ROWS = 4_000_000
VECTOR_ROWS = 1024


def retrieve(
    df: DataFrame,
    vector: Column,
    queries: DataFrame | list[tuple[object, list[float]]],
    k: int,
    *,
    row_id: str,
    query_id: str = "query_id",
    query_vector: Column | None = None,
    cosine: bool = False,
    digits: int | None = None,
    fan_in: int = topk.FAN_IN,
) -> DataFrame:
    """Best ``k`` rows per query by exact inner product; ties by ``row_id``.

    ``queries`` is a table (``query_id`` and the column ``query_vector``) or a list.  It is packed into
    blocks that Spark sends to the tasks; each meets blocks of vectors in one matrix product, and the best ``k`` of
    every query live across all batches of a task, which gives up only these.  So at most tasks x
    queries x k rows are shuffled, whatever ``k``.  With several blocks of queries the vectors are computed once and
    written to the shared folder.  ``cosine`` scales rows and queries to unit length in double precision first.  ``digits``
    compares rounded scores, so that floating-point noise cannot order equal rows.
    """
    spark = df.sparkSession
    if not isinstance(queries, DataFrame):
        kind = "string" if isinstance(queries[0][0], str) else "bigint"
        queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in queries], f"{query_id} {kind}, _query array<double>")
        query_vector = F.col("_query")
    first = queries.select(F.size(query_vector).alias("n")).where("n > 0").first()
    size = first.n if first else 1
    per_block = max(1, min(MAX_QUERY_VALUES // size, MAX_HELD_ROWS // max(1, k)))
    spread = queries.repartition(max(1, -(-queries.count() // per_block)))
    blocks = packed(spread, query_id, query_vector, per_block, cosine).withColumn("block", F.monotonically_increasing_id())
    folder = f"{shared_dir(spark)}/retrieve-{uuid.uuid4().hex}"
    blocks.write.parquet(f"{folder}/queries")
    blocks = spark.read.parquet(f"{folder}/queries")
    names = [r.block for r in blocks.select("block").collect()]
    vectors = packed(df, row_id, vector, VECTOR_ROWS, cosine)
    if len(names) > 1:  # read once per block of queries, computed once
        vectors.write.parquet(f"{folder}/vectors")
        vectors = spark.read.parquet(f"{folder}/vectors")

    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(row_id, df.schema[row_id].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("_compared", T.DoubleType()),
        ]
    )
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wanted, matrix = None, None, None
        for batch in batches:
            for ids, raw, query_ids, query_raw in zip(*(c.to_pylist() for c in batch.columns)):
                if best is None:
                    wanted, matrix = query_ids, np.frombuffer(query_raw).reshape(len(query_ids), -1).T
                    best = BestRows(k, len(wanted))
                scores = np.frombuffer(raw).reshape(len(ids), -1) @ matrix
                best.add(np.array(ids, object), scores, scores if digits is None else np.round(scores, digits))
        for name, (compared, score, rows) in zip(wanted or [], best.found if best else []):
            if len(rows):
                columns = [pa.array([name] * len(rows), target[0].type), pa.array(rows.tolist(), target[1].type), pa.array(score), pa.array(compared)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    parts = []
    for name in names:
        one = F.broadcast(blocks.where(F.col("block") == name).select(F.col("ids").alias("_ids"), F.col("matrix").alias("_matrix")))
        parts.append(vectors.crossJoin(one).mapInArrow(run, schema))  # one row of queries: a block, not pairs
    if not parts:
        return spark.createDataFrame([], schema).drop("_compared")
    found = reduce(DataFrame.unionByName, parts)
    return topk.top_k(found, k, topk.score_order("_compared", row_id), [query_id], fan_in).drop("_compared")


def retrieve_one(df: DataFrame, vector: Column, query: list[float], k: int, *, row_id: str) -> DataFrame:
    """Best ``k`` rows for a single query, all in the JVM; keeps the input columns."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("retrieval_score", inner_product(vector, literal))
    return topk.top_k(scored, k, topk.score_order("retrieval_score", row_id))


# ---------------------------------------------------------------------------
# relational term matching, for very many jobs
# ---------------------------------------------------------------------------


#: A token that stands for more than one in so many token rows is hot; there are fewer than this many of them.
HOT_SHARE = 1000
#: Token rows of a hot token that one join key takes.
KEY_ROWS = 100_000


def dealt_tokens(docs: DataFrame, key: str, token_set: Column, terms: DataFrame, hot_share: int, key_rows: int) -> tuple[DataFrame, DataFrame]:
    """Token rows of documents (``key, token, _part``) and term rows repeated for each part of their token."""
    spark = docs.sparkSession
    # the hash has a projection of its own below the generator, else every token hashes the whole set again
    sets = docs.select(key, token_set.alias("_set")).select(key, F.xxhash64(key, "_set").alias("_h"), "_set")
    path = f"{shared_dir(spark)}/token-rows-{uuid.uuid4().hex}"
    rows = sets.select(key, "_h", F.explode("_set").alias("token"))
    # texts are read once: only rows of tokens that some term holds go on
    rows.join(terms.select("token").distinct(), "token", "left_semi").select(key, "_h", "token").write.parquet(path)
    words = spark.read.parquet(path)
    counted = words.groupBy("token").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = counted.where((F.col("n") > key_rows) & (F.col("n") * hot_share > F.lit(total))).collect()
    n = F.lit(1).cast("long")
    if hot:
        known = F.create_map(*[F.lit(x) for r in hot for x in (r["token"], -(-r["n"] // key_rows))])
        n = F.coalesce(F.try_element_at(known, F.col("token")).cast("long"), n)
    dealt = words.select(key, "token", F.pmod("_h", n).cast("int").alias("_part"))
    return dealt, terms.withColumn("_part", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))


def token_overlap_join(
    docs: DataFrame, key: str, token_set: Column, terms: DataFrame, hot_share: int = HOT_SHARE, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Share of each term's tokens found in each document: ``(key, jd_id, term, coverage)``.

    ``terms`` has ``jd_id, term, token, n_tokens``, one row per term token.  The join is an equi-join on the
    token and a part.  Token rows that some term holds are written once to the shared folder and counted, combined before the shuffle; the rows of a hot token (more than
    ``key_rows``, and more than one in ``hot_share`` of the rows of all terms' tokens) are dealt to parts of about
    ``key_rows``, and its terms are repeated for each.  So a token that every document holds is no hot key.  The counts
    run when the join is called; the parts are a literal map of fewer than ``hot_share`` entries.  Documents with a null key count as one; pairs without any
    common token do not appear.
    """
    dealt, repeated = dealt_tokens(docs, key, token_set, terms, hot_share, key_rows)
    return (
        dealt.join(repeated, ["token", "_part"])
        .groupBy(key, "jd_id", "term")
        .agg((F.count("*") / F.first("n_tokens")).alias("coverage"))
    )
