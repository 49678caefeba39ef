"""Map the paths of an unknown record schema to semantic fields."""

from __future__ import annotations

import re

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import constants as C


def paths_of_struct(schema: T.StructType, prefix: str = "$") -> list[str]:
    """Paths of a Spark schema: ``$.a``, ``$.a.b``, ``$.list[]``, ``$.list[].x``."""
    paths: list[str] = []
    for f in schema.fields:
        here = f"{prefix}.{f.name}"
        paths.append(here)
        kind = f.dataType
        if isinstance(kind, T.ArrayType):
            here, kind = f"{here}[]", kind.elementType
            paths.append(here)
        if isinstance(kind, T.StructType):
            paths += paths_of_struct(kind, here)
    return paths


def struct_of_json_schema(doc: dict) -> T.StructType:
    """A JSON Schema document as a Spark schema; leaf types do not matter here."""

    def kind(node) -> T.DataType:
        if not isinstance(node, dict):
            return T.StringType()
        if node.get("type") == "object" or "properties" in node:
            return struct_of_json_schema(node)
        if isinstance(node.get("items"), dict):
            return T.ArrayType(kind(node["items"]))
        return T.StringType()

    return T.StructType([T.StructField(k, kind(v)) for k, v in doc.get("properties", {}).items()])


def paths_of_variants(df: DataFrame, column: str) -> list[str]:
    """Paths that occur in the data: one distributed aggregate, one row back."""
    merged = df.agg(F.schema_of_variant_agg(column).alias("s")).first()["s"]
    if not merged or not merged.startswith("OBJECT<"):
        return []
    # type words only: names in back quotes are matched first and stay as they are
    ddl = re.sub(r"`(?:[^`]|``)*`|\bOBJECT<|\bVOID\b(?!:)", _type_word, merged)
    return paths_of_struct(T.DataType.fromDDL(ddl))


def _type_word(m: re.Match) -> str:
    return {"OBJECT<": "STRUCT<", "VOID": "STRING"}.get(m.group(), m.group())


def paths_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def rank_paths(paths: DataFrame) -> DataFrame:
    """Best paths per semantic field: ``(field, rank, path, score)``.

    The score is the number of the field's keywords inside the lower-cased path.
    The fixed keyword list rides along as an array literal, so there is no join.
    """
    pairs = [
        F.struct(F.lit(name).alias("field"), F.lit(word).alias("word"))
        for name, found in C.SEMANTIC_KEYWORDS.items()
        for word in found
    ]
    hits = (
        paths.select("path", F.explode(F.array(*pairs)).alias("k"))
        .where(F.contains(F.lower("path"), F.col("k.word")))
        .groupBy(F.col("k.field").alias("field"), "path")
        .agg(F.count("*").alias("score"))
    )
    order = Window.partitionBy("field").orderBy(F.desc("score"), F.length("path"), "path")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= C.PATHS_PER_FIELD)
        .select("field", "rank", "path", "score")
    )


def schema_map_frame(paths: DataFrame) -> DataFrame:
    """One row per semantic field: ``(field, paths, confidence)``."""
    ranked = rank_paths(paths).groupBy("field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths")
    )
    names = F.explode(F.array(*[F.lit(n) for n in C.SEMANTIC_KEYWORDS])).alias("field")
    fields = paths.sparkSession.range(1).select(names)
    return fields.join(ranked, "field", "left").select(
        "field",
        F.coalesce("paths", F.array().cast("array<string>")).alias("paths"),
        F.least(F.lit(1.0), F.coalesce(F.size("paths"), F.lit(0)) / 3.0).alias("confidence"),
    )


@dataclass(frozen=True)
class SchemaMap:
    """Ranked paths per semantic field."""

    fields: dict[str, list[str]] = field(default_factory=dict)
    raw_paths: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> list[str]:
        return self.fields.get(name, [])

    def covering(self, name: str) -> list[str]:
        """Paths of a field without those inside another path of the field.

        Gives the same tokens and words as all paths, each value only once.
        """
        paths = self[name]
        return [
            p for p in paths if not any(p.startswith((q + ".", q + "[")) for q in paths)
        ]

    def confidence(self, name: str) -> float:
        return min(1.0, len(self[name]) / 3)

    @staticmethod
    def from_paths(spark: SparkSession, paths: list[str]) -> SchemaMap:
        return _compile(spark, tuple(paths))

    @staticmethod
    def from_json_schema(spark: SparkSession, doc: dict) -> SchemaMap:
        if not isinstance(doc, dict) or doc.get("type") not in (None, "object"):
            raise ValueError("a record schema must describe an object")
        return _compile(spark, tuple(paths_of_struct(struct_of_json_schema(doc))))

    @staticmethod
    def from_struct(spark: SparkSession, schema: T.StructType) -> SchemaMap:
        return _compile(spark, tuple(paths_of_struct(schema)))

    def identity_for_names(self) -> list[str]:
        """Identity paths with the likely names first and the ids last."""

        def tier(path: str) -> int:
            low = path.lower()
            return 0 if "name" in low else 2 if low.endswith("_id") or ".id" in low else 1

        return sorted(self["identity"], key=tier)

    def identity_ids(self) -> list[str]:
        return [p for p in self["identity"] if p.lower().endswith("_id")]

    def year_paths(self) -> list[str]:
        """Experience paths that hold a number of years and not a date."""
        return [
            p
            for p in self["experience"]
            if "year" in p.lower()
            and not any(bad in p.lower() for bad in ("date", "start_year", "end_year"))
        ]


@lru_cache(maxsize=256)
def _compile(spark: SparkSession, paths: tuple[str, ...]) -> SchemaMap:
    if not paths:
        return SchemaMap()
    rows = schema_map_frame(paths_frame(spark, list(paths))).collect()
    return SchemaMap({r["field"]: list(r["paths"]) for r in rows}, paths)
