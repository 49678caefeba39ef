"""Bounded-score arithmetic as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER_PATTERN = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def once(value: Column, use) -> Column:
    """Evaluate ``value`` a single time and use it several times.

    Lambda bodies are interpreted without common-subexpression elimination, so a value
    that an expression mentions n times would be computed n times per element.  The
    same holds for a column used inside a lambda: when Catalyst merges projections it
    moves the column's expression into the lambda body, unless it is bound like this.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clamp(value: Column) -> Column:
    """Limit to [0, 1]; null counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def soft_cap(value: Column, scale: float) -> Column:
    """Saturating growth ``1 - exp(-value/scale)`` for non-negative values."""
    if scale <= 0:
        return F.lit(0.0)
    return clamp(F.lit(1.0) - F.exp(-F.greatest(value.cast("double"), F.lit(0.0)) / F.lit(scale)))


def array_total(values: Column) -> Column:
    """Sum of a double array in array order (fixed order keeps results repeatable)."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    """Plain mean; null for an empty array."""
    return once(values, lambda v: F.when(F.size(v) > 0, array_total(v) / F.size(v)))


def mean_of_best(values: Column, n: int) -> Column:
    """Mean of the ``n`` largest values of a non-empty array."""
    best = F.slice(F.sort_array(values, asc=False), 1, n)
    return once(best, lambda v: array_total(v) / F.size(v))


def mean_score(values: Column) -> Column:
    """Mean limited to [0, 1]; 0 for an empty array."""
    return clamp(array_mean(values))


def semantic_rescale(raw: Column) -> Column:
    """Cosine range [-1, 1] to [0, 1]; anything outside is clamped as it is."""
    return F.when(raw.between(-1.0, 1.0), clamp((raw + 1.0) / 2.0)).otherwise(clamp(raw))


def number_from_text(text: Column) -> Column:
    """Decimal text to double, null when the text is not a number.

    Accepts surrounding white space, a sign, an exponent, digit groups joined by
    single underscores, ``inf`` and ``nan``; refuses type suffixes such as ``5d``,
    booleans and containers.
    """
    def careful(raw: Column) -> Column:
        return once(
            F.regexp_replace(raw, _EDGE_SPACE, ""),
            lambda t: F.when(t.rlike(_NUMBER_PATTERN), F.regexp_replace(t, "_", "").try_cast("double")),
        )

    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double")).otherwise(careful(text))


def non_zero_or(value: Column, default: float) -> Column:
    """``value``, or the default where it is null or zero."""
    return F.when(value != 0.0, value).otherwise(F.lit(default))
