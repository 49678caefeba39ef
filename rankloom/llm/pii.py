"""Personal data by a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  The field adds
what they miss: every token with a digit or ``@`` is a node, neighbouring tokens form a
chain, and distant tokens that repeat each other (same characters, or the same digits) are
joined by skip edges that reward equal labels, so a number once seen in full form is found
again where it stands without its prefix.  Two occurrences share one edge; of three and more,
each is tied to a hub node of its own (no evidence, no span), so that any two repeats are two
edges apart, however many there are.  Loopy sum-product message passing runs over all documents
of a batch at once.

Weights are learned here: node weights by softmax regression, chain and skip potentials by
smoothed pair counts, from all tokens of all documents as the base patterns label them: nodes
of equal features and label, and pairs of equal labels, are counted in Spark (a few thousand
rows at any size), so the field depends on the rows only, never on their order.

Defined results: null and empty texts have no spans; repeated rows are scanned each; an
empty table gives an empty result (the field then has zero weights and adds nothing).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import WORD_PATTERN, bound_batches, by_value, map_rows, span_text, utf8

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(WORD_PATTERN)
NODE = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")

ROUNDS = 6
DAMPING = 0.3
#: Least marginal of a label for a span of the field's own.
LEAST = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """The base pattern from each ``@``: it holds exactly one, with all local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_END.match(text[start - 1]) is None:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    spans = [(s, 0, "email", e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, "card", m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return sorted(spans)


# ---------------------------------------------------------------- nodes and features


def nodes_of(text: str) -> list[tuple[int, int, str]]:
    """Tokens with a digit or "@", without punctuation at their ends."""
    out = []
    for m in WORD.finditer(text):
        token = m.group()
        if NODE.search(token):
            core = token.rstrip(".,;:!?\"'")
            out.append((m.start(), m.start() + len(core), core))
    return [n for n in out if n[2]]


SHAPES = 7


def shape(token: str) -> int:
    """Coarse form: nothing, address, dotted digits, plus sign first, digits with marks, digits, mixed with letters."""
    if "@" in token:
        return 1
    if any(c.isalpha() for c in token):
        return 6
    if token.startswith("+"):
        return 3
    if token.count(".") == 3:
        return 2
    return 5 if token.isdigit() else 4


DIGIT_BINS = (1, 3, 4, 6, 9, 13, 19)  # upper ends
WIDTH = 1 + SHAPES + len(DIGIT_BINS) + 1 + 2 * SHAPES + SHAPES * (len(DIGIT_BINS) + 1)


def features(tokens: list[tuple[int, int, str]], follows: list[bool]) -> np.ndarray:
    """Active feature numbers of each node (form, digits, both, the neighbours' forms)."""
    shapes = [shape(t[2]) for t in tokens]
    out = np.zeros((len(tokens), 6), np.int32)
    for i, (_, _, token) in enumerate(tokens):
        digits = sum(c.isdigit() for c in token)
        size = next((b for b, top in enumerate(DIGIT_BINS) if digits <= top), len(DIGIT_BINS))
        before = shapes[i - 1] if follows[i] else 0
        after = shapes[i + 1] if i + 1 < len(tokens) and follows[i + 1] else 0
        at = 1 + SHAPES
        out[i, :3] = 0, 1 + shapes[i], at + size
        at += len(DIGIT_BINS) + 1
        out[i, 3:5] = at + before, at + SHAPES + after
        out[i, 5] = at + 2 * SHAPES + shapes[i] * (len(DIGIT_BINS) + 1) + size
    return out


@dataclass
class Graph:
    """Nodes of one document, chain edges (i-1, i) and skip edges between repeats; hubs are numbered after the tokens."""

    tokens: list
    feats: np.ndarray
    chain: list
    skip: list
    hubs: int = 0


def graph_of(text: str) -> Graph:
    tokens = nodes_of(text)
    follows = [i > 0 and text[tokens[i - 1][1] : tokens[i][0]].isspace() for i in range(len(tokens))]
    skip, seen = [], {}
    for i, (_, _, token) in enumerate(tokens):
        digits = NOT_DIGIT.sub("", token)
        keys = {("text", token.lower())} if len(token) >= 5 else set()
        if len(digits) >= 5:
            keys.add(("digits", digits[-7:]))
        for key in keys:
            seen.setdefault(key, []).append(i)
    hubs = len(tokens)
    for places in sorted({tuple(p) for p in seen.values() if len(p) > 1}):
        if len(places) == 2:
            skip.append(places)
        else:  # edges stay linear in the repeats
            skip += [(i, hubs) for i in places]
            hubs += 1
    chain = [(i - 1, i) for i in range(1, len(tokens)) if follows[i]]
    return Graph(tokens, features(tokens, follows), chain, skip, hubs - len(tokens))


def repeats(graph: Graph) -> list:
    """Each occurrence of a repeated token with the one before."""
    out, last = [], {}
    for a, b in graph.skip:
        if b < len(graph.tokens):
            out.append((a, b))
        else:
            if b in last:
                out.append((last[b], a))
            last[b] = a
    return sorted(set(out))


def labels_of(tokens: list, spans: list) -> list[int]:
    """Silver label of each token: the kind of the base span it stands in."""
    out, at, live = [], 0, []
    for start, end, _ in tokens:
        while at < len(spans) and spans[at][0] < end:
            live.append(spans[at])
            at += 1
        live = [s for s in live if s[3] > start]
        inside = [s for s in live if s[0] < end]
        out.append(1 + min(s[1] for s in inside) if inside else 0)
    return out


# ---------------------------------------------------------------- learning


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # log potentials of neighbouring labels
    skip: np.ndarray  # log potentials of labels of repeats


def fit(docs: DataFrame, text: str = "text", steps: int = 300) -> Field:
    """Learn the field from all documents with a digit or "@"."""

    def count(batches):
        seen = Counter()
        for (raws,) in batches:
            for raw in raws:
                body = raw.decode("utf-8", "replace")
                graph = graph_of(body)
                y = labels_of(graph.tokens, base_spans(body))
                seen.update((0, *x, label) for x, label in zip(graph.feats.tolist(), y))
                for kind, edges in ((1, graph.chain), (2, repeats(graph))):
                    seen.update((kind, len(LABELS) * y[a] + y[b]) for a, b in edges)
        for key, n in seen.items():
            yield list(key), n

    bound_batches(docs.sparkSession)
    some = docs.select(utf8(text)).where(F.col(text).cast("string").rlike("[0-9@]"))
    found = map_rows(some, count, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    found = sorted((tuple(r["key"]), r["n"]) for r in found)
    k = len(LABELS)
    nodes = [(key, n) for key, n in found if key[0] == 0]
    x, y = np.array([key[1:-1] for key, _ in nodes], np.int64).reshape(-1, 6), np.array([key[-1] for key, _ in nodes], np.int64)
    share = np.array([n for _, n in nodes], np.float64)[:, None]
    share /= max(share.sum(), 1.0)
    if not len(y):
        return Field(np.zeros((WIDTH, k)), np.zeros((k, k)), np.zeros((k, k)))
    weights, want = np.zeros((WIDTH, k)), np.eye(k)[y]
    for _ in range(steps):
        z = weights[x].sum(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = np.zeros_like(weights)
        for j in range(x.shape[1]):
            np.add.at(grad, x[:, j], share * (want - p))
        weights += 2.0 * grad - 1e-4 * weights

    def pair(kind):
        seen = np.full(k * k, 0.5)
        for key, n in found:
            if key[0] == kind:
                seen[key[1]] += n
        seen = seen.reshape(k, k)
        joint = seen / seen.sum()
        return np.clip(np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0)), -3.0, 3.0)

    same = np.log(np.eye(k) * 3 + 1)  # repeats agree, before any evidence
    return Field(weights, pair(1) / 2, (pair(2) + pair(2).T) / 4 + same)


# ---------------------------------------------------------------- inference


def marginals(graphs: list[Graph], field: Field) -> list[np.ndarray]:
    """Node marginals of all documents of a batch after ``ROUNDS`` of loopy message passing."""
    sizes = [len(g.tokens) + g.hubs for g in graphs]
    starts = np.cumsum([0, *sizes])
    n, k = int(starts[-1]), len(LABELS)
    unary = np.zeros((n, k))
    for g, s in zip(graphs, starts):
        unary[s : s + len(g.tokens)] = field.weights[g.feats].sum(axis=1)
    unary -= unary.max(axis=1, keepdims=True) if n else 0
    edges = [(s + a, s + b, t) for g, s in zip(graphs, starts) for t, e in enumerate((g.chain, g.skip)) for a, b in e]
    belief = unary
    if edges:
        e = np.array(edges)
        source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        pots = np.stack([field.chain, field.skip])[e[:, 2]]
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(e), 2 * len(e)), np.arange(len(e))])
        messages = np.zeros((2 * len(e), k))
        for _ in range(ROUNDS):
            out = (belief[source] - messages[back])[:, :, None] + pots
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
            into = np.stack([np.bincount(target, messages[:, j], minlength=n) for j in range(k)], axis=1)
            belief = unary + into
    p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else np.zeros((0, k))
    p /= p.sum(axis=1, keepdims=True) if n else 1
    return [p[a : a + len(g.tokens)] for g, a in zip(graphs, starts)]


def field_spans(graph: Graph, p: np.ndarray, base: list) -> list[tuple[int, int, str, int]]:
    """Runs of neighbouring nodes of one label, where no base span of any kind stands already."""
    runs, joined = [], {b for _, b in graph.chain}
    for i, (start, end, _) in enumerate(graph.tokens):
        label = int(p[i].argmax())
        if not label or p[i, label] < LEAST:
            continue
        if runs and runs[-1][4] == i - 1 and i in joined and runs[-1][1] == label - 1:
            runs[-1] = (*runs[-1][:3], end, i)
        else:
            runs.append((start, label - 1, KINDS[label - 1], end, i))
    out, at, reach = [], 0, -1
    for start, order, kind, end, _ in runs:
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][3])
            at += 1
        if reach <= start:
            out.append((start, order, kind, end))
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    field = field or fit(docs)

    def run(batches):
        for ids, raws in batches:
            rows, graphs, places = [], [], []
            for doc_id, raw in zip(ids, raws):
                text = raw.decode("utf-8", "replace")
                base = []
                if NODE.search(text):
                    base = base_spans(text)
                    graph = graph_of(text)
                    if graph.tokens:
                        graphs.append(graph)
                        places.append(len(rows))
                rows.append([doc_id, base, []])
            for place, graph, p in zip(places, graphs, marginals(graphs, field)):
                rows[place][2] = field_spans(graph, p, rows[place][1])
            for doc_id, base, extra in rows:
                n = [sum(s[1] == k for s in base) for k in range(4)]
                yield doc_id, *n, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(base + extra)

    bound_batches(docs.sparkSession)
    return map_rows(
        docs.select("doc_id", utf8()),
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )
