"""Check stored model replies: strip fences, parse, compare with the wanted shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import strip_code_fence

EXPLANATIONS = (
    "explanations array<struct<candidate_id:string,summary:string,recruiter_rationale:array<string>,"
    "interview_focus:array<string>,risk_notes:array<string>>>"
)


def validate_replies(df: DataFrame, content: str, shape: str, required: list[str]) -> DataFrame:
    """Add ``parsed`` and ``status``: ``ok``, ``invalid_json`` or ``invalid_shape``.

    A reply has the wrong shape when it is not an object, when a required field is
    absent or null, or when a value does not convert to the declared type.
    """
    body = strip_code_fence(F.col(content))
    schema = T.StructType.fromDDL(shape)
    df = df.withColumn("_body", body)
    v = F.try_parse_json("_body")
    parsed = F.from_json("_body", schema)
    complete = F.col("_body").startswith("{")
    for name in required:
        complete = complete & parsed[name].isNotNull()
    for name in schema.names:  # given but not convertible
        given = F.to_json(F.try_variant_get(v, f"$['{name}']", "variant"))
        complete = complete & (parsed[name].isNotNull() | given.isNull() | (given == "null"))
    status = (
        F.when(v.isNull(), F.lit("invalid_json"))
        .when(F.coalesce(complete, F.lit(False)), F.lit("ok"))
        .otherwise(F.lit("invalid_shape"))
    )
    return df.withColumn("status", status).withColumn(
        "parsed", F.when(F.col("status") == "ok", parsed)
    ).drop("_body")


def explanation_rows(replies: DataFrame, content: str, order: str | None = None) -> DataFrame:
    """Explanations out of valid batch replies, one row each, with their position.

    ``order`` names the replies' own order (a number or a time): the position is then (order, place),
    so that of two explanations of one id the one in the later reply is the last.
    """
    good = validate_replies(replies, content, EXPLANATIONS, []).where(F.col("status") == "ok")
    place = F.posexplode("parsed.explanations").alias("pos", "e")
    if order is None:
        return good.select(place).select("pos", "e.*")
    rows = good.select(F.col(order).alias("_order"), place)
    return rows.select(F.struct(F.col("_order").alias("reply"), F.col("pos").alias("place")).alias("pos"), "e.*")
