"""A training-data pipeline of five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the caller may write it
and read it again between stages.  All but the last return the columns of the table.
Results depend on the rows only, never on their order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, mixing, near_copies, quality_rules, secret_scan
from rankloom.llm.common import bound_batches, by_value, map_rows, stored
from rankloom.llm.registry import vocabulary_path

by_value(__name__)

VOCABULARY = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go."""
    # neutral names, as the table may have columns named like the verdict's
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    judged = quality_rules.judge(plain, keep=plain.columns, text=f"c{docs.columns.index('text')}")
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: one row of each class stays, whatever ids the rows have.

    It is the row of least id (rows without one last), then of the shortest and least text.  Texts without words,
    null ones too, are in no class and all stay.  Rows that equal it in id and text go like other copies.
    """
    # every row gets a number, written down once; classes are told by it, as ids may be null or repeated
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = stored(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    classes = near_copies.near_copies(plain.select(F.col("row").alias("doc_id"), text.alias("text"))).select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(doc_id.isNull(), doc_id, F.length(text), F.sha2(text.cast("binary"), 256), F.xxhash64(*names), F.col("row"))
    ranked = plain.select("row", order.alias("place")).join(classes, "row").groupBy("class_id").agg(F.min("place").alias("first"))
    return plain.join(ranked.select(F.col("first.row").alias("row")), "row", "left_semi").select(*names).toDF(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: the characters of every secret are replaced by a mark; all documents stay."""
    columns, at = docs.columns, docs.columns.index("text")
    long = docs.columns.index("n_chars")

    def run(batches):
        for values in batches:
            for row in zip(*values):
                text = row[at]
                if text is not None and (clean := secret_scan.redact(text)) != text:
                    row = list(row)
                    row[at] = clean
                    row[long] = len(clean)
                yield tuple(row)

    bound_batches(spark)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs.select(*columns), run, ddl)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents come as often as the mix takes them, the one at the budget's edge in part."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding: ids (little-endian unsigned 32-bit), their number, and digests of the ids and of the text decoded from them."""
    coded = bpe.encode_documents(docs, vocabulary_path(VOCABULARY), keep=("doc_id", "source"))
    return coded.select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", keep_good),
    ("near_copies", drop_copies),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: MinHash classes and BPE have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
