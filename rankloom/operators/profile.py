"""One flat profile row per record, from raw JSON or from typed columns.

Both adapters give the same columns, so every feature is written once:

``candidate_id, display_name, text, skills, listed_skills, title, headline,
reason_title, reason_location, role_text, profile_years, years, history,
education_text, education_count, location_text, experience_text, has_profile,
signals, signal_keys, availability_found``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import constants as C
from rankloom.functions import json_text as J
from rankloom.functions.numeric import array_total, number_from_text, once
from rankloom.functions.text import collapse_spaces, strip
from rankloom.operators.schema_map import SchemaMap

SKILL = "struct<name:string,proficiency:string,duration_months:double,endorsements:double>"
HISTORY = "struct<title:string,duration_months:double,is_current:boolean>"
PROFILE_COLUMNS = (
    "candidate_id display_name text skills listed_skills title headline reason_title reason_location role_text "
    "profile_years years history education_text education_count location_text "
    "experience_text has_profile signals signal_keys availability_found"
).split()
DEFAULT_SIGNALS_FIELD = "signals"

_MONTHS = r'"duration_months"\s*:\s*("(?:[^"\\]|\\.)*+"|[^,}\]\s]+)'


def _none(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def _empty(dtype: str) -> Column:
    return F.array().cast(f"array<{dtype}>")


def _in_human_range(values: Column) -> Column:
    return F.array_max(F.filter(values, lambda n: n.between(0.0, 50.0)))


def months_total(numbers: Column) -> Column:
    """Sum of the non-negative numbers, null when there is none."""
    valid = F.filter(numbers, lambda n: n >= 0.0)
    return once(valid, lambda v: F.when(F.size(v) > 0, array_total(v)))


def deep_duration_months(raw: Column) -> Column:
    """Every ``duration_months`` number at any depth of a raw JSON record."""
    found = F.regexp_extract_all(raw, F.lit(_MONTHS), F.lit(1))
    return F.transform(found, lambda x: number_from_text(F.regexp_replace(x, '^"|"$', "")))


def join_parts(*parts: Column, sep: str = " ") -> Column:
    """Non-empty parts joined by a separator."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)


# ---------------------------------------------------------------------------
# raw JSON
# ---------------------------------------------------------------------------


def parse_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the parsed record ``v``; null where the text is not valid JSON."""
    return df.withColumn("v", F.try_parse_json(raw))


_RAW_SKILL = "struct<name:string,proficiency:string,duration_months:string,endorsements:string>"
_DOUBTFUL = ("", "0", "0.0", "-0", "-0.0", "false", "[]", "{}")


def _said(text: Column, item: Column, name: str) -> Column:
    """Text of an object's field, null where the field is falsy.

    The text alone decides in almost every case; only for texts that may come from a
    falsy value is the typed value looked at.
    """
    typed = J.variant_truthy(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(text.isin(*_DOUBTFUL), F.when(typed, text)).otherwise(text)


def variant_skill(item: Column) -> Column:
    """A skill list item as a typed struct with its kind: object, text or other."""

    def of_object(raw: Column) -> Column:
        return F.struct(
            F.lit("object").alias("kind"),
            _said(raw["name"], item, "name").alias("name"),
            _said(raw["proficiency"], item, "proficiency").alias("proficiency"),
            number_from_text(raw["duration_months"]).alias("duration_months"),
            number_from_text(raw["endorsements"]).alias("endorsements"),
        )

    is_text = F.to_json(item).startswith('"')
    bare = F.struct(
        F.when(is_text, F.lit("text")).otherwise(F.lit("other")).alias("kind"),
        F.when(is_text, F.try_variant_get(item, "$", "string")).alias("name"),
        _none("string").alias("proficiency"),
        _none("double").alias("duration_months"),
        _none("double").alias("endorsements"),
    )
    return once(
        F.try_variant_get(item, "$", _RAW_SKILL),
        lambda raw: F.when(raw.isNotNull(), of_object(raw)).otherwise(bare),
    )


def _plain_skills(items: Column) -> Column:
    return F.transform(
        items, lambda s: F.struct(s["name"], s["proficiency"], s["duration_months"], s["endorsements"])
    ).cast(f"array<{SKILL}>")


def named_skills(items: Column) -> Column:
    """Usable skill records: text items, and objects with a name."""
    return F.filter(items, lambda s: (s["kind"] != "other") & s["name"].isNotNull())


def variant_history(value: Column) -> Column:
    raw_job = "struct<title:string,duration_months:string,is_current:variant>"

    def job(item: Column) -> Column:
        return once(
            F.try_variant_get(item, "$", raw_job),
            lambda r: F.struct(
                F.coalesce(_said(r["title"], item, "title"), F.lit("")).alias("title"),
                number_from_text(r["duration_months"]).alias("duration_months"),
                J.variant_truthy(r["is_current"]).alias("is_current"),
            ),
        )

    items = F.try_variant_get(value, "$.career_history", "array<variant>")
    return F.transform(items, job).cast(f"array<{HISTORY}>")


def variant_signals(signals: Column) -> Column:
    """Engagement signals of an object variant as one typed struct; null for other values."""
    fields = [f"{n}:string" for n in C.SIGNAL_NUMBERS.values()] + [f"{n}:variant" for n in C.SIGNAL_FLAGS.values()]
    shape = f"struct<{','.join(fields)},{C.SIGNAL_WORK_MODE}:string,{C.SIGNAL_ASSESSMENTS}:variant>"

    def typed(r: Column) -> Column:
        scores = F.map_values(F.try_variant_get(r[C.SIGNAL_ASSESSMENTS], "$", "map<string,variant>"))
        mode = _said(r[C.SIGNAL_WORK_MODE], signals, C.SIGNAL_WORK_MODE)
        return F.struct(
            *[number_from_text(r[n]).alias(k) for k, n in C.SIGNAL_NUMBERS.items()],
            *[J.variant_truthy(r[n]).alias(k) for k, n in C.SIGNAL_FLAGS.items()],
            strip(F.coalesce(mode, F.lit(""))).alias("work_mode"),
            F.coalesce(
                F.filter(F.transform(scores, J.variant_number), lambda n: n.isNotNull()), _empty("double")
            ).alias("assessments"),
        )

    return once(F.try_variant_get(signals, "$", shape), lambda r: F.when(r.isNotNull(), typed(r)))


def candidate_id_of(value: Column, schema_map: SchemaMap, row_id: Column | None, fallback: Column) -> Column:
    """First usable id of a parsed record."""
    options = [J.variant_scalar(F.try_variant_get(value, f"$.{k}", "variant")) for k in ("candidate_id", "id")]
    options.append(J.first_scalar(value, schema_map.identity_ids()))
    if row_id is not None:
        options.append(row_id.cast("string"))
    return F.coalesce(*options, fallback)


def display_name_of(value: Column, schema_map: SchemaMap, row_id: Column | None) -> Column:
    """First name-like scalar over the identity paths, else an id."""
    named = J.first_scalar(value, schema_map.identity_for_names())
    ids = [
        F.nullif(J.variant_string_or(F.try_variant_get(value, f"$.{k}", "variant")), F.lit(""))
        for k in ("candidate_id", "id")
    ]
    if row_id is not None:
        ids.append(row_id.cast("string"))
    return F.coalesce(named, *ids, F.lit("Unknown Candidate"))


def profiles_from_json(
    df: DataFrame,
    schema_map: SchemaMap,
    *,
    raw: str = "raw",
    keep: tuple[str, ...] = (),
    signals_field: str = DEFAULT_SIGNALS_FIELD,
    row_id: str | None = None,
    row_id_in_text: bool = True,
) -> DataFrame:
    """Profiles of raw JSON records.  ``row_id`` names records without an id and, with ``row_id_in_text``, joins the text as a field would."""
    if "v" not in df.columns:
        df = parse_records(df, raw)
    row = F.col(row_id) if row_id else None
    body = J.json_text(F.col(raw))
    text = F.concat_ws(" ", body, row.cast("string")) if row is not None and row_id_in_text else body
    kept = [F.col(c) for c in keep]
    v = F.col("v")
    fallback = J.resolve_paths(v, schema_map["skills"])
    first = df.select(
        *kept,
        v,
        F.col(raw).alias("_raw"),
        text.alias("text"),
        display_name_of(v, schema_map, row).alias("display_name"),
        F.try_variant_get(v, "$.profile", "map<string,variant>").alias("_profile"),
        F.try_variant_get(v, f"$['{signals_field}']", "variant").alias("_signals"),
        F.coalesce(
            F.transform(F.try_variant_get(v, "$.skills", "array<variant>"), variant_skill),
            _empty(f"struct<kind:string,{SKILL[7:]}"),
        ).alias("_items"),
        F.try_variant_get(v, "$.education", "variant").alias("_education"),
        *([row.alias("_row")] if row is not None else []),
    )
    field = lambda name: F.col("_profile").getItem(name)
    flat = lambda name: F.coalesce(J.json_text(F.to_json(field(name))), F.lit(""))
    named = named_skills(F.col("_items"))
    location = F.concat_ws(
        " ", flat("location"), flat("country"), J.paths_text(v, schema_map.covering("location"))
    )
    years = [J.path_values(v, p) for p in schema_map.year_paths()]
    year_numbers = F.transform(F.concat(*years), J.variant_number) if years else _empty("double")
    return first.select(
        *kept,
        candidate_id_of(v, schema_map, F.col("_row") if row is not None else None, F.col("display_name")).alias("candidate_id"),
        "display_name",
        "text",
        F.when(F.size(named) > 0, _plain_skills(named))
        .otherwise(_plain_skills(named_skills(F.transform(fallback, variant_skill))))
        .alias("skills"),
        _plain_skills(F.filter("_items", lambda s: s["kind"] == "object")).alias("listed_skills"),
        flat("current_title").alias("title"),
        flat("headline").alias("headline"),
        strip(J.variant_string_or(field("current_title"), "")).alias("_t"),
        strip(J.variant_string_or(field("headline"), "")).alias("_h"),
        join_parts(
            *[strip(J.variant_string_or(field(n), "")) for n in ("location", "country")], sep=", "
        ).alias("reason_location"),
        join_parts(
            J.paths_text(v, schema_map.covering("seniority")),
            J.paths_text(v, schema_map.covering("projects")),
        ).alias("role_text"),
        J.variant_number(field("years_of_experience")).alias("profile_years"),
        F.coalesce(
            J.variant_number(field("years_of_experience")),
            _in_human_range(year_numbers),
            months_total(deep_duration_months(F.col("_raw"))) / 12.0,
            F.lit(0.0),
        ).alias("years"),
        variant_history(v).alias("history"),
        F.when(J.variant_truthy(F.col("_education")), J.json_text(F.to_json("_education")))
        .otherwise(J.paths_text(v, schema_map["education"]))
        .alias("education_text"),
        F.coalesce(F.size(F.try_variant_get("_education", "$", "array<variant>")), F.lit(0)).alias("education_count"),
        location.alias("location_text"),
        # read for one warning only, which needs the word "present" somewhere in the record
        F.when(
            F.contains(F.lower("text"), F.lit("present")), J.paths_text(v, schema_map.covering("experience"))
        ).otherwise(F.lit("")).alias("experience_text"),
        F.coalesce(F.size("_profile") > 0, F.lit(False)).alias("has_profile"),
        variant_signals(F.col("_signals")).alias("signals"),
        F.coalesce(F.size(F.try_variant_get("_signals", "$", "map<string,variant>")), F.lit(0)).alias("signal_keys"),
        (F.size(J.resolve_paths(v, schema_map["availability"])) > 0).alias("availability_found"),
    ).select(*kept, *_with_reason_title())


def _with_reason_title() -> list[Column]:
    title = F.when(F.col("_t") != "", F.col("_t")).when(F.col("_h") != "", F.col("_h")).otherwise(F.lit("Candidate"))
    return [title.alias(c) if c == "reason_title" else F.col(c) for c in PROFILE_COLUMNS]


# ---------------------------------------------------------------------------
# typed columns
# ---------------------------------------------------------------------------


def value_text(col: Column, dtype: T.DataType) -> Column:
    """Searchable text of a typed value: its leaves in schema order, one space apart.

    Null and empty containers give an empty string, so their place is kept.
    """
    if isinstance(dtype, T.StructType):
        parts = [value_text(col[f.name], f.dataType) for f in dtype.fields]
        return F.when(col.isNull(), F.lit("")).otherwise(F.concat_ws(" ", *parts))
    if isinstance(dtype, T.MapType):
        return value_text(F.map_values(col), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: value_text(x, dtype.elementType))
        return F.coalesce(F.array_join(items, " "), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        text = F.when(col, F.lit("True")).when(~col, F.lit("False"))
    elif isinstance(dtype, T.StringType):
        text = collapse_spaces(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def record_text(df: DataFrame, columns: list[str]) -> Column:
    """Searchable text of typed record columns, leaf by leaf in schema order."""
    return F.concat_ws(" ", *[value_text(F.col(c), df.schema[c].dataType) for c in columns])


def _present(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return col.isNotNull() & (col != "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(col), F.lit(0)) > 0
    return col.isNotNull()


def _texts(col: Column, dtype: T.DataType) -> Column:
    return F.when(_present(col, dtype), F.array(value_text(col, dtype))).otherwise(_empty("string"))


def _scalars(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return _empty("string")
    text = strip(col) if isinstance(dtype, T.StringType) else value_text(col, dtype)
    return F.filter(F.array(text), lambda s: s.isNotNull() & (s != ""))


def _numbers(col: Column, dtype: T.DataType) -> Column:
    return F.filter(F.array(typed_number(col, dtype)), lambda n: n.isNotNull())


def typed_number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    return number_from_text(col) if isinstance(dtype, T.StringType) else _none("double")


def typed_truthy(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(col != 0, F.lit(False))
    return F.coalesce(_present(col, dtype), F.lit(False))


def typed_values(df: DataFrame, path: str, emit) -> Column | None:
    """Values at a path of a typed table; ``emit(column, type)`` gives an array per value."""

    def walk(col: Column, dtype: T.DataType, steps: list[str]):
        if not steps:
            return emit(col, dtype)
        name = steps[0].removesuffix("[]")
        if not isinstance(dtype, T.StructType) or name not in dtype.names:
            return None
        inner, kind = col[name], dtype[name].dataType
        if not steps[0].endswith("[]"):
            return walk(inner, kind, steps[1:])
        if not isinstance(kind, T.ArrayType):
            return None
        probe = walk(F.get(inner, F.lit(0)), kind.elementType, steps[1:])
        if probe is None:
            return None
        return F.coalesce(
            F.flatten(F.transform(inner, lambda x: walk(x, kind.elementType, steps[1:]))), F.array()
        )

    steps = path.removeprefix("$.").split(".")
    root = steps[0].removesuffix("[]")
    if root not in df.columns:
        return None
    wrapped = F.struct(F.col(root))
    return walk(wrapped, T.StructType([df.schema[root]]), steps)


def _gather(df: DataFrame, paths: list[str], emit, dtype: str) -> Column:
    found = [c for c in (typed_values(df, p, emit) for p in paths) if c is not None]
    return F.concat(*found) if found else _empty(dtype)


def typed_text(df: DataFrame, paths: list[str]) -> Column:
    """Joined text of all non-empty values at the paths."""
    return F.array_join(_gather(df, paths, _texts, "string"), " ")


def profiles_from_columns(
    df: DataFrame,
    schema_map: SchemaMap,
    *,
    record: list[str],
    keep: tuple[str, ...] = (),
    signals_field: str = DEFAULT_SIGNALS_FIELD,
) -> DataFrame:
    """Profiles of a typed table; ``record`` names the columns that make up a record."""
    types = {c: df.schema[c].dataType for c in record}

    def field(parent: str, name: str):
        kind = types.get(parent)
        if isinstance(kind, T.StructType) and name in kind.names:
            return F.col(parent)[name], kind[name].dataType
        return None, None

    def flat(name: str) -> Column:
        col, kind = field("profile", name)
        return F.lit("") if col is None else F.array_join(_texts(col, kind), " ")

    def scalar_text(name: str) -> Column:
        col, kind = field("profile", name)
        return F.lit("") if col is None else F.coalesce(F.get(_scalars(col, kind), F.lit(0)), F.lit(""))

    def top(name: str) -> Column:
        return F.get(_scalars(F.col(name), types[name]), F.lit(0)) if name in types else _none("string")

    years, years_type = field("profile", "years_of_experience")
    direct_years = _none("double") if years is None else typed_number(years, years_type)
    skills, listed = _typed_skills(types, schema_map, df)
    months = _gather(df, _paths_to(types, "duration_months"), _numbers, "double")
    named = [F.get(_gather(df, [p], _scalars, "string"), F.lit(0)) for p in schema_map.identity_for_names()]
    name = F.coalesce(
        *named,
        top("candidate_id"),
        top("id"),
        F.lit("Unknown Candidate"),
    )
    education = F.array_join(_texts(F.col("education"), types["education"]), " ") if "education" in types else F.lit("")
    is_list = isinstance(types.get("education"), T.ArrayType)
    available = F.size(_gather(df, schema_map["availability"], _texts, "string")) > 0
    return df.select(
        *keep,
        F.coalesce(
            top("candidate_id"),
            top("id"),
            F.get(_gather(df, schema_map.identity_ids(), _scalars, "string"), F.lit(0)),
            name,
        ).alias("candidate_id"),
        name.alias("display_name"),
        record_text(df, record).alias("text"),
        skills.alias("skills"),
        listed.alias("listed_skills"),
        flat("current_title").alias("title"),
        flat("headline").alias("headline"),
        scalar_text("current_title").alias("_t"),
        scalar_text("headline").alias("_h"),
        join_parts(scalar_text("location"), scalar_text("country"), sep=", ").alias("reason_location"),
        join_parts(typed_text(df, schema_map.covering("seniority")), typed_text(df, schema_map.covering("projects"))).alias("role_text"),
        direct_years.alias("profile_years"),
        F.coalesce(
            direct_years,
            _in_human_range(_gather(df, schema_map.year_paths(), _numbers, "double")),
            months_total(months) / 12.0,
            F.lit(0.0),
        ).alias("years"),
        _typed_history(types).alias("history"),
        F.when(education != "", education).otherwise(typed_text(df, schema_map["education"])).alias("education_text"),
        (F.coalesce(F.size("education"), F.lit(0)) if is_list else F.lit(0)).alias("education_count"),
        F.concat_ws(" ", flat("location"), flat("country"), typed_text(df, schema_map.covering("location"))).alias("location_text"),
        typed_text(df, schema_map.covering("experience")).alias("experience_text"),
        (F.col("profile").isNotNull() if "profile" in types else F.lit(False)).alias("has_profile"),
        _typed_signals(types, signals_field).alias("signals"),
        _typed_keys(types, signals_field).alias("signal_keys"),
        available.alias("availability_found"),
    ).select(*keep, *_with_reason_title())


def _paths_to(types: dict[str, T.DataType], leaf: str) -> list[str]:
    from rankloom.operators.schema_map import paths_of_struct

    schema = T.StructType([T.StructField(c, t) for c, t in types.items()])
    return [p for p in paths_of_struct(schema) if p.split(".")[-1] == leaf]


def _skill_of(item: Column, kind: T.DataType) -> Column:
    def part(name: str, convert, dtype: str) -> Column:
        has = isinstance(kind, T.StructType) and name in kind.names
        return (convert(item[name], kind[name].dataType) if has else _none(dtype)).alias(name)

    text = lambda c, t: F.nullif(c.cast("string"), F.lit(""))
    name = item.alias("name") if isinstance(kind, T.StringType) else part("name", text, "string")
    return F.struct(
        name,
        part("proficiency", text, "string"),
        part("duration_months", typed_number, "double"),
        part("endorsements", typed_number, "double"),
    )


def _typed_skills(types: dict[str, T.DataType], schema_map: SchemaMap, df: DataFrame) -> tuple[Column, Column]:
    none = _empty(SKILL)
    fallback = F.transform(
        _gather(df, schema_map["skills"], _text_values, "string"),
        lambda s: F.struct(s.alias("name"), _none("string"), _none("double"), _none("double")),
    ).cast(f"array<{SKILL}>")
    kind = types.get("skills")
    if not isinstance(kind, T.ArrayType):
        return fallback, none
    items = F.coalesce(
        F.transform("skills", lambda s: _skill_of(s, kind.elementType)).cast(f"array<{SKILL}>"), none
    )
    usable = F.filter(items, lambda s: s["name"].isNotNull())
    listed = items if isinstance(kind.elementType, T.StructType) else none
    return F.when(F.size(usable) > 0, usable).otherwise(fallback), listed


def _text_values(col: Column, dtype: T.DataType) -> Column:
    return F.filter(F.array(col), lambda s: s.isNotNull() & (s != "")) if isinstance(dtype, T.StringType) else _empty("string")


def _typed_history(types: dict[str, T.DataType]) -> Column:
    kind = types.get("career_history")
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return _none(f"array<{HISTORY}>")
    inner = kind.elementType

    def part(item: Column, name: str, convert, default: Column) -> Column:
        return convert(item[name], inner[name].dataType) if name in inner.names else default

    return F.transform(
        "career_history",
        lambda i: F.struct(
            part(i, "title", lambda c, t: F.coalesce(c.cast("string"), F.lit("")), F.lit("")).alias("title"),
            part(i, "duration_months", typed_number, _none("double")).alias("duration_months"),
            part(i, "is_current", typed_truthy, F.lit(False)).alias("is_current"),
        ),
    ).cast(f"array<{HISTORY}>")


def _typed_signals(types: dict[str, T.DataType], name: str) -> Column:
    kind = types.get(name)
    kind = kind if isinstance(kind, T.StructType) else T.StructType([])

    def part(source: str, convert, default: Column) -> Column:
        return convert(F.col(name)[source], kind[source].dataType) if source in kind.names else default

    def numbers_of(col: Column, dtype: T.DataType) -> Column:
        value_type = dtype.valueType if isinstance(dtype, T.MapType) else T.StringType()
        numbers = F.transform(F.map_values(col), lambda x: typed_number(x, value_type))
        return F.coalesce(F.filter(numbers, lambda n: n.isNotNull()), _empty("double"))

    fields = F.struct(
        *[part(s, typed_number, _none("double")).alias(k) for k, s in C.SIGNAL_NUMBERS.items()],
        *[part(s, typed_truthy, F.lit(False)).alias(k) for k, s in C.SIGNAL_FLAGS.items()],
        part(C.SIGNAL_WORK_MODE, lambda c, t: F.coalesce(strip(c.cast("string")), F.lit("")), F.lit("")).alias("work_mode"),
        part(C.SIGNAL_ASSESSMENTS, numbers_of, _empty("double")).alias("assessments"),
    )
    return F.when(F.col(name).isNotNull() if name in types else F.lit(False), fields)


def _typed_keys(types: dict[str, T.DataType], name: str) -> Column:
    kind = types.get(name)
    if not isinstance(kind, T.StructType):
        return F.lit(0)
    return F.when(F.col(name).isNotNull(), F.lit(len(kind.names))).otherwise(F.lit(0))
