"""Searchable text and typed values out of raw JSON.

Text comes from the raw string, because it keeps the source order of the fields;
values at known paths come from VARIANT, because it copes with fields whose type
differs between records.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.numeric import number_from_text, once
from rankloom.functions.text import collapse_spaces, strip

# String (with an optional ':' that makes it a key), number, word, empty container.
# The possessive quantifiers keep very long strings off the matcher's stack.
_LEXEMES = (
    r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?|-?\d[0-9.eE+\-]*|true|false|null|\[\s*\]|\{\s*\}'
)


def unquote(lexeme: Column) -> Column:
    """Content of a JSON string literal."""
    plain = F.substring(lexeme, F.lit(2), F.length(lexeme) - 2)
    escaped = F.get(F.from_json(F.concat(F.lit("["), lexeme, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.contains(lexeme, F.lit("\\")), escaped).otherwise(plain)


def json_leaves(raw: Column) -> Column:
    """Leaf values of a JSON text in source order, as normalised strings.

    Null and empty containers give an empty string, so their place is kept.
    """
    lexemes = F.regexp_extract_all(raw, F.lit(_LEXEMES), F.lit(0))
    values = F.filter(lexemes, lambda x: ~x.endswith(":"))
    return F.transform(
        values,
        lambda x: F.when(x.startswith('"'), collapse_spaces(unquote(x)))
        .when(x.startswith("n") | x.startswith("[") | x.startswith("{"), F.lit(""))
        .when(x == "true", F.lit("True"))
        .when(x == "false", F.lit("False"))
        .otherwise(x),
    )


def json_text(raw: Column) -> Column:
    """All leaf values of a JSON text joined by one space."""
    return F.array_join(json_leaves(raw), " ")


def _steps(path: str) -> list[str]:
    return path.removeprefix("$.").split(".")


def _variant_path(keys: list[str]) -> str:
    # keys with an apostrophe take double quotes; the path syntax has no escapes
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


def _at(value: Column, keys: list[str], dtype: str) -> Column:
    return F.try_variant_get(value, _variant_path(keys), dtype) if keys else F.try_variant_get(value, "$", dtype)


def path_values(value: Column, path: str) -> Column:
    """Values at one ``$.a.b[].c`` path as ``array<variant>``; ``[]`` fans out."""
    return _fan_out(value, _steps(path))


def _fan_out(value: Column, steps: list[str]) -> Column:
    keys: list[str] = []
    for i, step in enumerate(steps):
        if step.endswith("[]"):
            items = _at(value, [*keys, step[:-2]], "array<variant>")
            rest = steps[i + 1 :]
            empty = F.array().cast("array<variant>")
            if not rest:
                return F.coalesce(items, empty)
            return F.coalesce(
                F.flatten(F.transform(items, lambda item: _fan_out(item, rest))), empty
            )
        keys.append(step)
    return F.array(_at(value, keys, "variant"))


def resolve_paths(value: Column, paths: list[str]) -> Column:
    """Non-empty values over several paths, in path order, as ``array<variant>``."""
    if not paths:
        return F.array().cast("array<variant>")
    found = F.concat(*[path_values(value, p) for p in paths])
    return F.filter(found, lambda x: x.isNotNull() & ~F.to_json(x).isin("null", '""', "[]", "{}"))


def paths_text(value: Column, paths: list[str]) -> Column:
    """Searchable text of everything at the paths; empty values leave only spaces."""
    if not paths:
        return F.lit("")
    return F.trim(json_text(F.to_json(F.concat(*[path_values(value, p) for p in paths]))))


def first_scalar(value: Column, paths: list[str]) -> Column:
    """First string or number over the paths; later paths are only read if needed."""
    found = [
        F.get(F.filter(F.transform(path_values(value, p), variant_scalar), lambda s: s.isNotNull()), F.lit(0))
        for p in paths
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def resolved_text(values: Column) -> Column:
    """Searchable text of resolved values."""
    return F.when(F.size(values) > 0, json_text(F.to_json(values))).otherwise(F.lit(""))


def variant_number(value: Column) -> Column:
    """Number coercion: booleans, containers and other words become null."""
    return number_from_text(F.try_variant_get(value, "$", "string"))


def variant_truthy(value: Column) -> Column:
    """Any value other than null, false, zero or an empty string or container."""
    return once(
        F.to_json(value),
        lambda js: F.when(js == "true", F.lit(True))
        .when(js.isNull() | js.isin("null", "false", '""', "[]", "{}"), F.lit(False))
        .otherwise(~js.rlike(r"^-?0(?:\.0+)?(?:[eE].*)?$")),
    )


def variant_scalar(value: Column) -> Column:
    """Trimmed string, or the text of a number or boolean; null for anything else."""
    text = once(
        F.to_json(value),
        lambda js: F.when(js.startswith('"'), strip(F.try_variant_get(value, "$", "string")))
        .when(js == "true", F.lit("True"))
        .when(js == "false", F.lit("False"))
        .when(js.startswith("[") | js.startswith("{") | js.startswith("n"), F.lit(None).cast("string"))
        .otherwise(js),
    )
    return F.nullif(text, F.lit(""))


def variant_string_or(value: Column, default: str = "") -> Column:
    """Text of a truthy scalar, otherwise the default."""
    return F.coalesce(F.when(variant_truthy(value), variant_scalar(value)), F.lit(default))


def is_json(raw: Column) -> Column:
    """One complete JSON value and nothing after it (the parser alone stops at the value's end)."""
    return once(
        F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))),
        lambda v: v.isNotNull() & F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(),
    )
