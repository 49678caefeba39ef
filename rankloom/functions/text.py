"""Tokens, term matching and phrase clean-up as native column expressions.

Token sets are arrays without duplicates.  A record's tokens are extracted once;
every later comparison works on ``array_intersect`` results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import constants as C
from rankloom.functions.numeric import clamp, mean_of_best, once

# all white space of Unicode text, with and without the plain space
_ODD_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = f"[ {_ODD_SPACE}]+"


def words(values: list[str]) -> Column:
    """Literal string array."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def collapse_spaces(text: Column) -> Column:
    """White-space runs become one space; the ends are trimmed.

    Most values have nothing to collapse, and a look is cheaper than a rewrite.
    """
    untidy = text.rlike(f"  |[{_ODD_SPACE}]")
    return F.trim(F.when(untidy, F.regexp_replace(text, SPACE_RUN, " ")).otherwise(text))


def tokens(text: Column) -> Column:
    """Distinct lower-cased search tokens of a text.

    The matches hold ASCII only and no spaces, so they are joined, lower-cased and
    split in three vectorisable calls instead of one lambda call per token.
    """
    joined = F.array_join(F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0)), " ")
    return F.array_remove(F.array_distinct(F.split(F.lower(joined), " ")), "")


def signal_tokens(token_set: Column, drop_generic: bool = False) -> Column:
    """Token set without stopwords and, on request, without generic skill words."""
    noise = C.STOPWORDS + C.GENERIC_SKILL_WORDS if drop_generic else C.STOPWORDS
    return F.array_except(token_set, words(noise))


def coverage(term_tokens: Column, text_tokens: Column) -> Column:
    """Share of the term's tokens found in the text (term must be non-empty)."""
    return shared_tokens(term_tokens, text_tokens) / F.size(term_tokens)


def shared_tokens(few: Column, others: Column) -> Column:
    """How many of a few distinct tokens are among others; null for no array.

    An intersection builds a hash set at every call, which costs a term of one to three tokens several times the look-up itself.
    """
    return F.when(others.isNotNull(), F.size(F.filter(few, lambda w: F.array_contains(others, w))))


def clean_terms(terms: Column) -> Column:
    """Collapse spaces, drop blanks, keep the first of case-insensitive duplicates."""
    tidy = F.filter(F.transform(terms, collapse_spaces), lambda t: t != "")
    keyed = F.transform(tidy, lambda t: F.struct(t.alias("term"), F.lower(t).alias("key")))

    def firsts(items: Column) -> Column:
        keys = F.transform(items, lambda x: x["key"])
        return once(keys, lambda k: F.filter(items, lambda x, i: F.array_position(k, x["key"]) == i + 1))

    return F.transform(once(keyed, firsts), lambda x: x["term"])


def term_is_present(lowered_text: Column, text_tokens: Column, lowered: Column, term_tokens: Column) -> Column:
    """Term occurs as a substring, or all of its tokens occur."""
    return F.contains(lowered_text, lowered) | (
        (F.size(term_tokens) > 0) & F.forall(term_tokens, lambda w: F.array_contains(text_tokens, w))
    )


def present_terms(lowered_text: Column, text_tokens: Column, terms: Column) -> Column:
    """Terms (structs with ``lowered`` and ``words``) that the text mentions."""
    text = F.struct(lowered_text.alias("low"), text_tokens.alias("tokens"))
    return once(
        text,
        lambda x: F.filter(
            terms, lambda t: term_is_present(x["low"], x["tokens"], t["lowered"], t["words"])
        ),
    )


def keyword_density(text_tokens: Column, terms: Column) -> Column:
    """Depth and breadth of a list of terms (``array<array<string>>``) in a token set.

    Depth is the mean of the best six positive term scores, breadth the share of
    terms with any hit.  Terms must be non-empty token arrays.
    """

    def scores(found: Column) -> Column:
        return F.transform(
            terms, lambda t: F.least(F.lit(1.0), F.pow(coverage(t, found), F.lit(1.2)))
        )

    def combined(hits: Column) -> Column:
        spread = F.pow(F.size(hits) / F.size(terms), F.lit(0.7))
        return F.when(
            F.size(hits) > 0, clamp(0.62 * mean_of_best(hits, 6) + 0.38 * spread)
        ).otherwise(F.lit(0.0))

    positive = once(text_tokens, lambda found: F.filter(scores(found), lambda s: s > 0))
    return F.coalesce(once(positive, combined), F.lit(0.0))


def metric_mentions(lowered_text: Column) -> Column:
    """How many measured claims ("40 ms", "3k", "200 users") the text makes."""
    # the look-ahead rejects non-digits before the costlier word boundary is tested
    return F.regexp_count(lowered_text, F.lit(r"(?U)(?=\d)" + C.METRIC_PATTERN))


def occurrences(lowered_text: Column, word: str) -> Column:
    """Non-overlapping substring count of one literal word."""
    return F.regexp_count(lowered_text, F.lit(word))


def mentions_any(text: Column, needles: list[str]) -> Column:
    """Any needle occurs as a substring."""
    return text.rlike("|".join(n.replace("-", r"\-") for n in needles))


def skill_label(skill: Column) -> Column:
    """Skill without one leading praise word."""
    return F.regexp_replace(strip(skill), "(?iU)" + C.SKILL_PREFIX_PATTERN, "")


def canonical_skill(skill: Column) -> Column:
    """Lower-cased skill without praise and filler words or punctuation."""
    lowered = F.lower(skill_label(skill))
    bare = F.regexp_replace(lowered, "(?U)" + C.SKILL_FILLER_PATTERN, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9+#.]+", " "), " +", " "))


def is_ai_skill(name: Column) -> Column:
    """Name contains one of the fixed AI or data keywords anywhere."""
    return mentions_any(F.lower(name), C.AI_KEYWORDS)


def strip_code_fence(content: Column) -> Column:
    """Drop a leading fence line and, if there was one, a trailing fence line."""
    body = strip(content)
    opened = F.regexp_replace(body, r"^```[^\n]*(?:\n|$)", "")
    closed = F.regexp_replace(opened, r"(?:^|\n)```[^\n]*$", "")
    return F.when(body.startswith("```"), strip(closed)).otherwise(body)


def truncate_text(text: Column, n_chars: int = C.JOB_TEXT_CHARS) -> Column:
    """Leading characters of a job text, as sent to an extraction service."""
    return F.substring(text, 1, n_chars)


def strip(text: Column) -> Column:
    """Text without white space at the ends."""
    return F.regexp_replace(text, f"^{SPACE_RUN}|{SPACE_RUN}$", "")


def join_titles(title: Column, headline: Column) -> Column:
    """Current title and headline side by side."""
    return F.concat_ws(" ", title, headline)
