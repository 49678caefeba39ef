"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it.  Rules differ widely in cost and in how much
they reject, so both are measured on a sample and the rules run in the order of rejection
per cost; the first rejection ends the document's evaluation.  The verdict is a
conjunction, and ``rejected_by`` names the first rejecting rule in a fixed order, so the measured order
changes the time, never the result.

Defined results: null and empty texts have no words and are rejected (``few_words``);
repeated rows get one verdict each; an empty table gives an empty result; columns other
than the named ones are not looked at and never clash.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, map_rows, utf8

by_value(__name__)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Expected number of documents of the cost sample; it decides the order of the rules only.
SAMPLE_ROWS = 512
#: Tasks that measure it, so that not every input split starts Python for a document or none.
SAMPLE_TASKS = 8


class Measures:
    """Measures of one text, each computed when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def text(self) -> str:
        return self.raw.decode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: exactly the six ASCII space characters

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def n_exclaims(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def n_upper(self) -> int:
        """Upper-case letters of A-Z and Latin-1."""
        return len(UPPER.findall(self.text))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window that the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        found, covered, end = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if found[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")

#: Rule -> rejects(measures).  The first two are the base rules.
RULES = {
    "few_words": lambda m: m.n_words < 50,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "exclaims": lambda m: 5 * m.n_exclaims > m.n_words,
    "shouting": lambda m: 10 * m.n_upper > 3 * m.word_chars,
    "repeated_lines": lambda m: len(m.lines) >= 4 and 100 * m.n_dup_lines > 30 * len(m.lines),
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words,
}
BASE_RULES = ("few_words", "repeated_windows")


def first_rejection(raw: bytes, order: Sequence[str]) -> tuple[Measures, str | None]:
    """Measures, and for a rejected text the first rule of ``RULES`` that rejects it, in whatever order the cascade ran."""
    measures = Measures(raw)
    if not any(RULES[r](measures) for r in order):
        return measures, None
    return measures, next(r for r in RULES if RULES[r](measures))


def rule_order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by measured rejections per second on a sample of about ``rows`` documents (all of a smaller table), best first.

    Rows are drawn each on its own with the probability ``rows`` / number of rows, so no task sorts or gathers more than
    the sample, however many splits there are.  The sample and the clock may order rules differently on another run; verdicts and
    ``rejected_by`` do not depend on it."""
    names = list(RULES)

    def measure(batches):
        for (raws,) in batches:
            for raw in raws:
                for name in names:
                    fresh = Measures(raw)  # a rule is charged for all that it needs
                    start = time.perf_counter()
                    rejects = RULES[name](fresh)
                    yield name, int(rejects), time.perf_counter() - start

    bound_batches(docs.sparkSession)
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.select(utf8(text)).sample(share, seed=SAMPLE_ROWS).repartition(SAMPLE_TASKS)
    found = map_rows(some, measure, "rule string, rejects long, seconds double")
    seen = {r["rule"]: r for r in found.groupBy("rule").agg(F.sum("rejects").alias("n"), F.sum("seconds").alias("s")).collect()}
    gain = {name: seen[name]["n"] / max(seen[name]["s"], 1e-9) if name in seen else 0.0 for name in names}
    return sorted(names, key=lambda name: -gain[name])


def judge(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", order: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns, ``kept`` and ``rejected_by`` (the first rejecting rule in the order of ``RULES``, else null)."""
    order = list(order or rule_order(docs, text))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def cascade(batches):
        for *kept, raws in batches:
            for *values, raw in zip(*kept, raws):
                rule = first_rejection(raw, order)[1]
                yield *values, rule is None, rule

    bound_batches(docs.sparkSession)
    # keep columns may include the text itself, so the bytes get a name of their own
    rows = docs.select(*keep, utf8(text).alias("_raw"))
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_rows(rows, cascade, f"{ddl}, kept boolean, rejected_by string")


def report(docs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Verdict with the base measures of every document (all measured, whatever the verdict)."""
    order = list(order or rule_order(docs))

    def run(batches):
        for ids, raws in batches:
            for doc_id, raw in zip(ids, raws):
                m, rule = first_rejection(raw, order)
                base = any(RULES[r](m) for r in BASE_RULES)
                yield doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base, rule is None, rule

    bound_batches(docs.sparkSession)
    return map_rows(
        docs.select("doc_id", utf8()),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, rejected_by string",
    )


#: The report in SQL: the same rules over measures taken from all words, lines and characters.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM s),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY r),
m AS (SELECT s.r, doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM s LEFT JOIN covered ON covered.r = s.r),
v AS (SELECT *, CASE WHEN n_words < 50 THEN 'few_words' WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_windows'
    WHEN 10 * n_symbols > n_words THEN 'symbols' WHEN 5 * n_exclaims > n_words THEN 'exclaims'
    WHEN 10 * n_upper > 3 * word_chars THEN 'shouting' WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 'repeated_lines'
    WHEN NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) THEN 'word_length' END AS rejected_by FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, rejected_by IS NULL AS kept, rejected_by FROM v"""
