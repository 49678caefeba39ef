"""Secret scans: base patterns and sliding-window Shannon entropy.

Candidate strings are runs of key characters.  Per character class (hex, base-36 of one
letter case, base-64) a window slides over each string; its entropy follows from counts
that change by one character per step.  A string whose best window reaches the class's
threshold is a secret unless the allow list knows it (words, paths, digests announced as
such, versions, plain numbers).

Defined results: null and empty texts have no spans; repeated rows are scanned each;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from rankloom.llm.common import bound_batches, by_value, map_rows, span_text, utf8

by_value(__name__)

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"[0-9a-f]{32,}+")  # shorter runs are dropped anyway
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
#: A candidate needs a digit and a letter; most long words have no digit.
DIGIT = re.compile(r"[0-9]")

#: Character class -> (its characters, window, least entropy in bits per character).
CLASSES = {
    "hex": (re.compile(r"[0-9a-f]{20,}+|[0-9A-F]{20,}+"), 20, 2.9),
    "base36": (re.compile(r"[0-9a-z]{20,}+|[0-9A-Z]{20,}+"), 20, 3.3),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}+"), 20, 3.6),
}
ALLOWED = [
    re.compile(p)
    for p in (
        r"[0-9_=+/-]+",  # plain numbers and rules
        r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[0-9]{0,4}",  # words, paths and identifiers with a number
        r"(.{1,4})\1+.{0,3}",  # a short unit repeated
        r"(?:sha(?:1|256|512)|md5)-[A-Za-z0-9+/=]+",  # announced digests
    )
]
#: n log2 n for counts within a window.
N_LOG_N = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def best_entropy(string: str, window: int) -> float:
    """Largest Shannon entropy (bits per character) of any window, by incremental counts."""
    counts: dict[str, int] = {}
    total, best = 0.0, 0.0  # total: sum of n log2 n over the window's characters
    full = math.log2(window)
    for i, c in enumerate(string):
        n = counts.get(c, 0)
        total += N_LOG_N[n + 1] - N_LOG_N[n]
        counts[c] = n + 1
        if i >= window:
            old = string[i - window]
            n = counts[old]
            total -= N_LOG_N[n] - N_LOG_N[n - 1]
            counts[old] = n - 1
        if i >= window - 1:
            best = max(best, full - total / window)
    return best


def is_secret(string: str) -> bool:
    """A run of one character class inside the candidate reaches that class's entropy."""
    if not DIGIT.search(string) or any(p.fullmatch(string) for p in ALLOWED):
        return False
    mixed = string.upper() != string != string.lower()
    return any(
        best_entropy(run, window) >= least
        for name, (pattern, window, least) in CLASSES.items()
        if mixed or name != "base64"
        for run in pattern.findall(string)
        if DIGIT.search(run)
    )


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    spans = []
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def entropy_spans(text: str) -> list[tuple[int, int, str, int]]:
    return [(m.start(), 3, "entropy", m.end()) for m in CANDIDATE.finditer(text) if is_secret(m.group())]


def scan_text(text: str) -> tuple[list, list]:
    """Base spans, and spans found by entropy alone (not inside a base span)."""
    base, extra, reach, at = sorted(base_spans(text)), [], -1, 0
    for span in entropy_spans(text):
        while at < len(base) and base[at][0] <= span[0]:
            reach = max(reach, base[at][3])
            at += 1
        if reach < span[3]:
            extra.append(span)
    return base, extra


def redact(text: str) -> str:
    """Every secret's characters replaced by one mark per merged span."""
    base, extra = scan_text(text)
    out, at = [], 0
    for start, _, kind, end in sorted(base + extra):
        if end <= at:
            continue
        out.append(text[at : max(start, at)])
        if start >= at:
            out.append("[SECRET]")
        at = end
    out.append(text[at:])
    return "".join(out)


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""

    def run(batches):
        for ids, raws in batches:
            for doc_id, raw in zip(ids, raws):
                base, extra = scan_text(raw.decode("utf-8", "replace"))
                n = [sum(s[1] == k for s in base) for k in range(3)]
                yield doc_id, *n, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(base + extra)

    bound_batches(docs.sparkSession)
    return map_rows(
        docs.select("doc_id", utf8()),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
