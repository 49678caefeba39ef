"""Language-model scoring by online logistic context mixing of bit predictors.

A text is its lower-cased words and one end; a word is coded by its bytes and a closing
space, each byte by eight binary decisions.  For every bit, contexts (orders 0 to 3, place
and last byte, and the whole word so far) give predictions from their counts; a gate,
chosen by how much the two most specific contexts have seen, picks the weights that mix them
in the logistic domain; an adaptive map of (byte so far, prediction) refines the result.  The bits'
code lengths add up to the log probability.  Orders 2 and 3 run on over the border of two words: what
a word's first two bytes follow (the text starts after zeros) are the last bytes of the words before.
No context reaches further, so the bits of these two bytes are scored once per
distinct border (``borders``), and those of the bytes after them once per distinct word.

How it is spread: blocks of documents become bags of local numbers of words and of borders.  Borders
are grouped by place and last byte before (``Border``, at most 65,536 in a group), which
gives all counts of orders 2 and 3 across borders; each group learns weights of its own gates, which are averaged.
Counts of words are summed in Spark.  Orders 0 and 1 and the place have a slot for every context there can be
(``REGIONS``): every task fills such a table from its share of the distinct words, and they are
summed piece by piece.  Orders 2 and 3 and the word so far grow with the input.  Words are sorted
by their codes and cut into units; each unit asks for its own contexts, and their counts are
summed over all units in Spark and joined back (``ready``).  A prefix's words are neighbours, so of
the words so far only the contexts of a unit's first and last word go on beyond it.  All counts
are those of the whole table, the word so far from place ``HEAD`` on, at every size.  Weights and
refinement are learned online on every unit's words, each left out of the counts that predict
it, and averaged.  Words and borders are joined back to blocks by Spark (one row
per block and word or border, so a word that is in every text is no hot key), and each block adds up
its documents.  All training texts are learned from, at every size.

Defined results: null and empty texts hold the end only; null ids are never held out, and
learned from; repeated rows are scored and learned from each; without training tokens the
base score is 0 for every token and the model knows nothing (one bit per bit); an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, sigmoid, stored, utf8

by_value(__name__)

FOLDS = 10
BLOCK_BYTES = 16 << 20
END = b""  # the token after the last word
#: Slots of each short context's table: orders 0 and 1, place and last byte.
REGIONS = (1 << 8, 1 << 16, 1 << 20)
OFFSETS = np.concatenate([[0], np.cumsum(REGIONS)]).astype(np.int64)
SHORT = len(REGIONS)
LONG = 3  # orders 2 and 3, the word so far
#: Bytes of a word before its word-so-far context counts.
HEAD = 4
#: One word in so many (by hash) may begin a unit, every so many of these does; and their first bytes that are compared.
CUT, EVERY, CUT_BYTES = 8192, 8, 256
#: Most words and bytes of a unit (one word at least).
UNIT_WORDS, UNIT_BYTES = 1 << 17, 1 << 20
PIECE = 1 << 15  # slots summed together
BRANCHES = 16  # groups in which the tasks' results are added up first
WORD_GATES = 64
GATES = WORD_GATES + 8  # those of a word's first bytes by how often order 3 was seen across the border
INPUTS = SHORT + LONG + 1  # and a constant
STEP = 0.1
APM = 33
CHUNK = 8192  # words at a time
BATCH = 2048  # bits at a time while learning
CROSS = 2  # first bytes of a word that orders 2 and 3 predict from the words before
PART_BYTES = 1 << 20  # texts of one row of a block
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LEAST_P = 1e-6
STEPS = 2.0 ** np.arange(7) - 1  # counts above which the next step begins
SMALL = 32  # counts below this share their predictions
PRIME = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- bit predictors


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def contexts(words: list[bytes], long: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of every byte: its word's number, its place, its value, and each short context before it, or each long one (the word so far as a hash)."""
    coded = [w + b" " if w else b"\n" for w in words]
    sizes = np.array([len(w) for w in coded], np.int64)
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(coded)), sizes)
    first = (np.cumsum(sizes) - sizes)[owner]
    place = np.arange(len(data)) - first

    def back(k):
        out = np.zeros(len(data), np.uint64)
        out[k:] = data[:-k]
        out[place < k] = 0
        return out

    if not long:
        b1 = back(1)
        return owner, place, data.astype(np.int64), [np.zeros(len(data), np.uint64), b1, (np.minimum(place, 15).astype(np.uint64) << np.uint64(8)) | b1]
    powers = np.ones(int(sizes.max()), np.uint64)
    powers[1:] = np.uint64(PRIME)
    powers = np.multiply.accumulate(powers)
    terms = (data + np.uint64(1)) * powers[place]
    sums = np.cumsum(terms) - terms
    so_far = mixed(sums - sums[first]) >> np.uint64(8)  # room for a node below
    two = (back(2) << np.uint64(8)) | back(1)
    return owner, place, data.astype(np.int64), [two, (back(3) << np.uint64(16)) | two, so_far]


def bits(data: np.ndarray, found: list[np.ndarray]):
    """Level by level: the bits, the byte so far and each short context's slot."""
    node = np.ones(len(data), np.int64)
    short = [(c << np.uint64(8)).astype(np.int64) + o for c, o in zip(found, OFFSETS)]
    for level in range(7, -1, -1):
        bit = (data >> level) & 1
        yield bit, node, [c + node for c in short]
        node = node * 2 + bit


def count_words(words: list[bytes], counts: np.ndarray, table: np.ndarray) -> None:
    """Add the words' bits, with their counts, to ``table`` (slots of zeros, then of ones)."""
    owner, _, data, found = contexts(words)
    weight = counts[owner].astype(np.float64)
    for bit, _, slots in bits(data, found):
        for s in slots:
            np.add.at(table, s + bit * OFFSETS[-1], weight)


def chunks(words: list[bytes], start: int):
    """``CHUNK`` words at a time: their slice, the numbers of their bytes from place ``start`` on among all words' bytes, and these bytes' contexts."""
    first = 0
    for at in range(0, len(words), CHUNK):
        owner, place, data, found = contexts(words[at : at + CHUNK])
        some = np.flatnonzero(place >= start)
        yield slice(at, at + CHUNK), first + some, (owner[some], place[some], data[some], [c[some] for c in found])
        first += len(owner)


def borders(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every token's borders as codes, and the number of each one's text.

    A code is the place (0 or 1) and three bytes: the two that stand before, apart from the space between the words, and
    the one that is coded.  A text starts after zeros; its end is one byte, so it has no place 1."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = ~SPACE[data]
    first, end = (np.flatnonzero(x) + 1 for x in (inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]))
    data = data.astype(np.int32)
    doc = np.searchsorted(np.cumsum(sizes) - sizes + 1, first, side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    opening = np.diff(doc, prepend=-1) != 0
    alone = end - first == 1
    before = np.where(alone, np.where(opening, 0, ord(" ")), data[end - 2])
    tail = np.concatenate([[0], before << 8 | data[end - 1]]).astype(np.int32)  # after each word; none at first
    ends = np.where(words > 0, tail[np.cumsum(words)], 0)
    tail = np.where(opening, 0, tail[:-1])
    second = np.where(alone, ord(" "), data[np.minimum(first + 1, len(data) - 1)])
    codes = [tail << 8 | data[first], ends << 8 | ord("\n"), 1 << 24 | (tail & 255) << 16 | data[first] << 8 | second]
    return np.concatenate(codes).astype(np.int64), np.concatenate([doc, np.arange(len(texts)), doc])


class SoFar:
    """Counts of the longer contexts (orders 2 and 3, and the word so far) at every bit of one unit's words.

    Without ``totals`` they are the unit's own.  A word so far and the bits after it stand for a range
    of the sorted words, so it reaches beyond the unit only if the unit's first or last word is in it:
    these, and all of orders 2 and 3, are ``asked``, and ``totals`` replaces them.  With ``own`` (as in
    ``predictions``) the predictions are kept in place of the counts.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, totals: tuple[np.ndarray, np.ndarray] | None = None, own: bool | None = None):
        owner, place, data, found = contexts(words, long=True)
        weight, data = counts[owner].astype(np.float64), data.astype(np.uint64)
        codes = [w + b" " if w else b"\n" for w in words]
        ends = np.isin(owner, [codes.index(min(codes)), codes.index(max(codes))]) & (place >= HEAD)
        self.span, self.entry, self.groups, self.zeros, self.ones, self.asked, self.found, self.own, at = None, [], [], [], [], [], [], own, 0
        for kind, context in enumerate(found):
            # each distinct context and byte is one entry, which all its places share
            coded = context << np.uint64(8) | data
            order = np.argsort(coded)
            coded = coded[order]
            heads = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]]))
            entry = np.empty(len(order), np.int32)
            entry[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(heads, append=len(order)))
            self.entry.append(entry)
            c, d, w = coded[heads] & ~np.uint64(255), coded[heads] & np.uint64(255), np.add.reduceat(weight[order], heads)
            at_ends = np.zeros(len(heads), bool)
            at_ends[entry[ends]] = True
            for level in range(7, -1, -1):
                path = c | np.uint64(1 << (7 - level)) | d >> np.uint64(level + 1)
                new = np.concatenate([[True], path[1:] != path[:-1]])
                heads, group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
                one = np.add.reduceat(np.where(d & np.uint64(1 << level), w, 0.0), heads)
                zero = np.add.reduceat(w, heads) - one
                some = np.unique(group[at_ends]) if kind == LONG - 1 else np.arange(len(one))
                if totals is None:  # orders 2 and 3 take less than 40 bits, and get their number above
                    name = path[new][some] if kind == LONG - 1 else path[new] | np.uint64(kind + 1 << 40)
                    self.asked.append((name.view(np.int64), zero[some], one[some]))
                else:
                    zero[some], one[some] = (t[at : at + len(some)] for t in totals)
                    at += len(some)
                zero, one = zero.astype(np.float32), one.astype(np.float32)
                if own is None:
                    self.groups.append(group)
                    self.zeros.append(zero)
                    self.ones.append(one)
                else:
                    self.found.append(paired(zero, one, group, own))

    def __call__(self, level: int, span: slice, active: np.ndarray, kind: int = LONG - 1):
        group = self.groups[8 * kind + level][self.entry[kind][span]]
        return self.zeros[8 * kind + level][group] * active, self.ones[8 * kind + level][group] * active

    def predict(self, own: bool) -> None:
        """Compute every group's predictions once; ``own`` as in ``predictions``."""
        if self.own is not own:
            self.own, self.found = own, [paired(*x, own) for x in zip(self.zeros, self.ones, self.groups)]

    def all(self, level: int, span: slice, bit) -> list:
        """Of every longer context: each byte's stretched prediction and its step; its counts, before ``predict``."""
        if self.own is None:
            return [self(level, span, 1, kind) for kind in range(LONG)]
        if self.span is not span:  # the same bytes at every level
            self.span, self.here = span, [entry[span] for entry in self.entry]
        out = []
        for entry, (x, step, pair) in zip(self.here, self.found[level::8]):
            mine = pair.take(entry) + bit * x.shape[1]
            out.append((x.take(mine), step.take(mine)))
        return out


def paired(n0: np.ndarray, n1: np.ndarray, group: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``predictions`` of every pair of small counts and of each other group's, and which of these is each entry's."""
    rest = (n0 >= SMALL) | (n1 >= SMALL)
    pair = np.where(rest, 0, n0 * SMALL + n1).astype(np.int32)
    small = np.arange(SMALL * SMALL)
    pair[rest] = np.arange(rest.sum()) + len(small)
    return *predictions(np.append(small // SMALL, n0[rest]), np.append(small % SMALL, n1[rest]), own), pair[group]


def predictions(n0: np.ndarray, n1: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of contexts from their counts, and steps by how often they were seen.

    With ``own``, two rows, for either bit: its own occurrence is left out of the counts.  A context that has
    only seen one bit is surer the more it has seen."""
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    pairs = [(np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))] if own else [(n0, n1)]
    x = np.stack([np.log((b + 0.02) / (a + 0.02)).astype(np.float32) for a, b in pairs])
    return x, np.stack([steps(a + b).astype(np.int8) for a, b in pairs])


class Mixer:
    """Gated weights over the stretched predictions, and the adaptive refinement."""

    def __init__(self, table: np.ndarray):
        self.table, self.own = table, None
        # to begin with, trust the word so far the more it has been seen, else orders 3 and 2
        trust = np.minimum(1.0, 0.3 * (np.arange(GATES) // 8 % 8))[:, None]
        rest = np.array([0.02, 0.05, 0.05, 0.25, 0.65, 0.0, 0.0])
        self.weights = (1 - trust) * rest
        self.weights[:, INPUTS - 2] += trust[:, 0]
        self.squares = np.full((GATES, INPUTS), 1e-3)
        self.hits = np.zeros((256 * APM, 2))  # weight, weight of ones

    def predict(self, own: bool) -> None:
        """Compute the short contexts' predictions once; ``own`` as in ``predictions``."""
        if self.own is not own:
            self.own, (self.short, _) = own, predictions(self.table[: OFFSETS[-1]], self.table[OFFSETS[-1] :], own)

    def inputs(self, slots, long, active, bit) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and gates.  ``bit`` is 0 where its own occurrence counts."""
        x = np.empty((INPUTS, len(active)), np.float32)
        for i, s in enumerate(slots):
            x[i] = self.short.take(s + bit * self.short.shape[1])
        for i, (found, step) in enumerate(long, SHORT):
            x[i] = found
        x[INPUTS - 2] *= active  # a word so far that does not count yet predicts nothing
        x[-1] = 0.3
        return x, (8 * (step * active) + long[-2][1]).astype(np.int64)

    def mix(self, x, gate):
        weights = self.weights.T.astype(np.float32)
        z = x[0] * weights[0].take(gate)
        for i in range(1, INPUTS):
            z += x[i] * weights[i].take(gate)
        return np.clip(z, -14.0, 14.0)

    def learn(self, words: list[bytes], counts: np.ndarray, depth: np.ndarray, so_far: SoFar, start: int = 0) -> None:
        """Learn from the words' bytes from place ``start`` on."""
        self.predict(True)
        so_far.predict(True)
        for some, span, (owner, place, data, found) in chunks(words, start):
            weight, active = counts[some][owner].astype(np.float64), place >= depth[some][owner]
            for level, (bit, node, slots) in enumerate(bits(data, found)):
                self.learn_bits(*self.inputs(slots, so_far.all(level, span, bit), active, bit), node, bit, weight)

    def learn_bits(self, x, gate, node, bit, weight) -> None:
        zs = np.empty(len(bit))
        for at in range(0, len(bit), BATCH):
            part = slice(at, at + BATCH)
            xs, gs, ws = x[:, part], gate[part], weight[part]
            z = zs[part] = self.mix(xs, gs)
            error = (bit[part] - sigmoid(z)) * ws
            total = np.maximum(np.bincount(gs, ws, GATES), 1.0)
            step = np.stack([np.bincount(gs, error * xs[i], GATES) / total for i in range(INPUTS)], axis=1)
            self.squares += step * step
            self.weights += STEP * step / np.sqrt(self.squares)
        self.refine(node, zs, bit, weight)

    def cells(self, node, z):
        at = (np.clip(z, -8.0, 8.0) + 8.0) * ((APM - 1) / 16.0)
        low = np.minimum(at.astype(np.int64), APM - 2)
        return node * APM + low, at - low

    def refine(self, node, z, bit, weight):
        cell, part = self.cells(node, z)
        both, parts = np.concatenate([cell, cell + 1]), np.concatenate([weight * (1 - part), weight * part])
        self.hits[:, 0] += np.bincount(both, parts, len(self.hits))
        self.hits[:, 1] += np.bincount(both, parts * np.concatenate([bit, bit]), len(self.hits))

    def refined(self) -> np.ndarray:
        """Probability of each refinement cell, between its own hits and its place's value."""
        prior = sigmoid(np.tile(np.linspace(-8.0, 8.0, APM), 256))
        return (self.hits[:, 1] + 50.0 * prior) / (self.hits[:, 0] + 50.0)

    def log10_probability(self, words: list[bytes], depth: np.ndarray, so_far: SoFar, start: int = 0) -> np.ndarray:
        """Of the words' bytes from place ``start`` on."""
        total, table = np.zeros(len(words)), self.refined()
        self.predict(False)
        so_far.predict(False)
        for some, span, (owner, place, data, found) in chunks(words, start):
            active = place >= depth[some][owner]
            for level, (bit, node, slots) in enumerate(bits(data, found)):
                p = self.log10_bits(*self.inputs(slots, so_far.all(level, span, 0), active, 0), node, bit, table)
                total[some] += np.bincount(owner, p, len(total[some]))
        return total

    def log10_bits(self, x, gate, node, bit, table) -> np.ndarray:
        z = self.mix(x, gate)
        cell, part = self.cells(node, z)
        p = 0.5 * sigmoid(z) + 0.5 * (table[cell] * (1 - part) + table[cell + 1] * part)
        p = np.clip(p, LEAST_P, 1 - LEAST_P)
        return np.log10(np.where(bit, p, 1 - p))


class Border:
    """Distinct borders of one place and one last byte before, with their training counts.

    All contexts but order 3 are the same for the whole group, with one prediction a node; the counts of orders 2
    and 3 are all in the group."""

    def __init__(self, code: np.ndarray, counts: np.ndarray, table: np.ndarray, own: bool):
        place, last = int(code[0]) >> 24, int(code[0]) >> 8 & 255
        self.before, self.data, self.counts, self.own = code >> 16 & 255, code & 255, counts, own
        three = np.zeros((256, 256))
        three[self.before, self.data] = counts
        b1 = last if place else 0
        slots = (OFFSETS[:SHORT] + (np.array([0, b1, place << 8 | b1]) << 8))[:, None] + np.arange(256)
        alike = [np.concatenate(x) for x in zip((table[slots], table[slots + OFFSETS[-1]]), nodes(three.sum(axis=0, keepdims=True)))]
        self.alike, _ = predictions(*alike, own)
        self.three, self.step = predictions(*nodes(three), own)

    def levels(self):
        """Level by level: the inputs, gates, bytes so far and bits."""
        for bit, node, _ in bits(self.data, []):
            mine = bit if self.own else 0
            x = np.zeros((INPUTS, len(bit)), np.float32)  # no word so far yet
            for i in range(SHORT + 1):
                x[i] = self.alike[mine, i, node]
            x[SHORT + 1] = self.three[mine, self.before, node]
            x[-1] = 0.3
            yield x, WORD_GATES + self.step[mine, self.before, node].astype(np.int64), node, bit

    def learn(self, mixer: Mixer) -> None:
        for at in self.levels():
            mixer.learn_bits(*at, self.counts.astype(np.float64))

    def log10_probability(self, mixer: Mixer) -> np.ndarray:
        table = mixer.refined()
        return sum(mixer.log10_bits(*at, table) for at in self.levels())


def nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at every byte so far, from rows of 256 counts of bytes."""
    n0, n1 = np.zeros(counts.shape), np.zeros(counts.shape)
    for level in range(8):
        parts = counts.reshape(len(counts), 1 << level, 2, -1).sum(axis=3)
        n0[:, 1 << level : 2 << level], n1[:, 1 << level : 2 << level] = parts[:, :, 0], parts[:, :, 1]
    return n0, n1


def steps(seen: np.ndarray) -> np.ndarray:
    """0 to 7 by how often a context was seen."""
    return np.searchsorted(STEPS, seen, side="left")


# ---------------------------------------------------------------- Spark


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def planes(x: np.ndarray) -> bytes:
    """Four-byte numbers, all their first bytes, then all their second ones: small ones compress well."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents, each in parts: ids, held-out marks, and bags of the block's numbers of words and of borders.
    A block's last part brings its words and the borders' codes with their training counts.  ``block`` is unique in one written result."""
    import pyarrow as pa

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0

        def numbered():
            """Numbers from 0 for what is looked up, in the order of the first time."""
            return defaultdict(count().__next__)

        local, train, codes, learned, size = numbered(), np.zeros(0), numbered(), np.zeros(0), 0
        ids, held, texts, bags, waiting = [], [], [], [], 0

        def steps_of(doc, numbers, counts):
            # a document's numbers rise, and are kept as steps
            order = np.argsort(doc << 32 | numbers)
            ends = np.cumsum(np.bincount(doc, minlength=len(ids)))
            return [np.append(0, ends).astype("<i4").tobytes(), planes(np.diff(numbers[order], prepend=0)), planes(counts[order])]

        def crossed():
            code, doc = borders(texts)
            both, often = np.unique(doc << 32 | code, return_counts=True)
            doc, (some, mine) = both >> 32, np.unique(both & 0xFFFFFFFF, return_inverse=True)
            mine = np.array([codes[x] for x in some.tolist()])[mine]
            return mine, doc, often

        def more(known, doc, numbers, counts, length):
            """Training counts with those of one part."""
            out = np.bincount(numbers, counts * ~np.array(held)[doc], length)
            out[: len(known)] += known
            return out

        def part(last):
            nonlocal local, train, codes, learned
            words, tf = (np.fromiter(chain.from_iterable(b[i] for b in bags), np.int64) for i in (0, 1))
            doc = np.repeat(np.arange(len(ids)), [len(b[0]) for b in bags])
            mine, where, often = crossed()
            train, learned = more(train, doc, words, tf, len(local)), more(learned, where, mine, often, len(codes))
            row = [
                (task << 32) + number, np.array([x or 0 for x in ids], "<i8").tobytes(), np.array([x is None for x in ids]).tobytes(), np.array(held).tobytes(),
                planes(np.array([len(t) for t in texts])), *steps_of(doc, words, tf), *steps_of(where, mine, often),
                *((list(local), train.astype(np.int64), list(codes), learned.astype(np.int64)) if last else ([], [], [], [])),
            ]
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)
            for x in (ids, held, texts, bags):
                x.clear()
            if last:
                local, codes, train, learned = numbered(), numbered(), np.zeros(0), np.zeros(0)
            return out

        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), *[pa.binary()] * 10, pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for doc_id, raw, out in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting >= PART_BYTES:
                    last = size >= BLOCK_BYTES
                    yield part(last)
                    waiting, size, number = 0, 0 if last else size, number + last
                raw = raw.lower()
                counts = Counter(raw.split())
                counts[END] = 1
                places = [local[w] for w in counts]
                bags.append((places, list(counts.values())))
                ids.append(doc_id)
                held.append(out)
                texts.append(raw)
                size, waiting = size + len(raw) + 64, waiting + len(raw) + 64
        if ids:
            yield part(True)

    schema = (
        "block long, ids binary, null binary, held binary, sizes binary, firsts binary, local binary, tf binary, border_firsts binary, border binary, border_tf binary, "
        "words array<binary>, train array<long>, codes array<int>, learned array<long>"
    )
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), utf8(), held_out().alias("held"))
    return stored(rows.mapInArrow(run, schema), "lm-blocks")


def units(words: DataFrame) -> DataFrame:
    """The words (``word``, ``c``) by the order of their codes, in bounded units that follow from the words only; mixed inside a unit."""
    import pyarrow as pa

    spark = words.sparkSession
    code = F.when(F.length("word") == 0, F.lit(bytearray(b"\n"))).otherwise(F.concat("word", F.lit(bytearray(b" "))))
    rows = words.select(code.alias("code"), F.col("c").cast("long").alias("c"))
    firsts = rows.where(F.pmod(F.xxhash64("code"), F.lit(CUT)) == 0).select(F.substring("code", 1, CUT_BYTES).alias("f")).distinct().sort("f")
    cuts = [bytes(r["f"]) for r in firsts.toLocalIterator()][EVERY - 1 :: EVERY]
    shared = spark.sparkContext.broadcast(cuts)

    def place(batches):
        for batch in batches:
            at = [bisect_right(shared.value, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["at", "code", "c"])

    def cut(batches):
        last, number, size, codes, counts = None, 0, 0, [], []

        def done():
            order = np.random.default_rng(len(codes)).permutation(len(codes))
            row = [(last << 32) + number], [[codes[i][:-1] for i in order]], [[counts[i] for i in order]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=["unit", "words", "counts"])

        types = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        for batch in batches:
            for at, code, c in zip(*(x.to_pylist() for x in batch.columns)):
                if codes and (at != last or len(codes) >= UNIT_WORDS or size + len(code) > UNIT_BYTES):
                    yield done()
                    number, size, codes, counts = number + 1 if at == last else 0, 0, [], []
                last, size = at, size + len(code)
                codes.append(code)
                counts.append(c)
        if codes:
            yield done()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cuts) + 1)
    numbered = rows.mapInArrow(place, "at int, code binary, c long").repartitionByRange(tasks, "at").sortWithinPartitions("at", "code")
    return stored(numbered.mapInArrow(cut, "unit long, words array<binary>, counts array<long>"), "lm-units")


def ready(own: DataFrame) -> DataFrame:
    """Units with the counts, over the whole table, of the contexts that may go on beyond them (``n0``, ``n1``)."""
    import pyarrow as pa

    names = ["unit", "n", "name", "n0", "n1"]

    def ask(batches):
        for unit, words, counts in rows_of(batches):
            name, n0, n1 = map(np.concatenate, zip(*SoFar(words, np.array(counts, np.int64)).asked))
            for at in range(0, len(name), PIECE):
                some = slice(at, at + PIECE)
                n = np.arange(len(name), dtype=np.int32)[some]
                columns = [np.full(len(n), unit), n, name[some], n0[some].astype(np.int64), n1[some].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"of": [pdf["unit"].iloc[0]], **{k: [pdf[k].to_numpy().astype("<f4").tobytes()] for k in ("n0", "n1")}})

    same = Window.partitionBy("name")
    asked = own.mapInArrow(ask, "unit long, n int, name long, n0 long, n1 long")
    whole = asked.select("unit", "n", *(F.sum(k).over(same).alias(k) for k in ("n0", "n1")))
    packed = whole.groupBy("unit").applyInPandas(pack, "of long, n0 binary, n1 binary")
    return stored(own.join(packed, F.col("unit") == F.col("of"), "left").select("words", "counts", "n0", "n1"), "lm-ready")


def rows_of(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def whole_units(batches, own: bool | None = None):
    """Words, counts, depth and so-far counts of every unit; with ``own``, predictions in place of the counts."""
    for words, counts, n0, n1 in rows_of(batches):
        counts = np.array(counts, np.int64)
        totals = tuple(np.frombuffer(x or b"", "<f4") for x in (n0, n1))
        yield words, counts, np.full(len(words), HEAD), SoFar(words, counts, totals, own)


def context_table(known: DataFrame) -> np.ndarray:
    """Counts of all contexts: filled by every task, summed piece by piece, of fixed size."""
    import pyarrow as pa

    def fill(batches):
        table = np.zeros(2 * int(OFFSETS[-1]))
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            for at in range(0, len(words), CHUNK):
                count_words(words[at : at + CHUNK], counts[at : at + CHUNK], table)
        for at in range(0, len(table), PIECE):
            part = table[at : at + PIECE]
            if part.any():
                used = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([used.astype("<u2").tobytes()]), pa.array([part[used].astype("<f8").tobytes()])], names=["at", "slots", "counts"]
                )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE)
        for slots, counts in zip(pdf["slots"], pdf["counts"]):
            total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, "<f8")
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "counts": [total.astype("<f4").tobytes()]})

    parts = known.select("word", F.col("c").cast("long")).mapInArrow(fill, "at long, slots binary, counts binary")
    # two rounds, so that no task adds up the pieces of all others
    spread = parts.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    half = spread.groupBy("at", "branch").applyInPandas(add, "at long, counts binary")
    dense = half.select("at", "counts")

    def add_dense(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<f4").astype(np.float64) for c in pdf["counts"])
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "counts": [total.astype("<f4").tobytes()]})

    summed = dense.groupBy("at").applyInPandas(add_dense, "at long, counts binary")
    table = np.zeros(-(-2 * int(OFFSETS[-1]) // PIECE) * PIECE, np.float32)
    for row in summed.toLocalIterator():
        table[row["at"] : row["at"] + PIECE] = np.frombuffer(row["counts"], "<f4")
    return table[: 2 * int(OFFSETS[-1])]


def fit(words: DataFrame, known: DataFrame, crossed: DataFrame) -> Mixer:
    """Learn from a table of distinct words and their training counts (``word``, ``c``), the same in units, ready,
    and one of distinct borders (``code``, ``c``).

    The counts of the short contexts add up in any order, so they take the table as it lies."""
    import pyarrow as pa

    table = context_table(words.where("c > 0"))
    shared = known.sparkSession.sparkContext.broadcast(table)

    def learn(batches):
        total, sums = 0, [0.0, 0.0]
        for words, counts, depth, so_far in whole_units(batches, True):
            n, mixer = int(counts.sum()), Mixer(shared.value)
            if n:
                mixer.learn(words, counts, depth, so_far, CROSS)
                total, sums = total + n, [a + b for a, b in zip(sums, (n * mixer.weights, mixer.hits))]
        if total:
            flat = [x.astype("<f8").tobytes() for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array([total]), *(pa.array([x]) for x in flat)], names=["n", "weights", "hits"])

    def learn_borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code").sample(frac=1.0, random_state=len(pdf))
        n, mixer = int(pdf["c"].sum()), Mixer(shared.value)
        Border(pdf["code"].to_numpy(np.int64), pdf["c"].to_numpy(), shared.value, True).learn(mixer)
        return pd.DataFrame({"n": [n], "weights": [(n * mixer.weights).tobytes()], "hits": [mixer.hits.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {k: [sum(np.frombuffer(x, "<f8") for x in pdf[k]).tobytes()] for k in ("weights", "hits")}
        return pd.DataFrame({"n": [pdf["n"].sum()], **sums})

    schema, mixer = "n long, weights binary, hits binary", Mixer(table)

    def take(learned: DataFrame, gates: slice) -> None:
        """Average the weights of these gates, add the hits."""
        # one row per task or group, then one per branch: what reaches the driver does not grow with the tasks
        rows = learned.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES))).groupBy("branch").applyInPandas(lambda pdf: add(pdf), schema).collect()
        if rows:
            weights = sum(np.frombuffer(r["weights"], "<f8") for r in rows) / sum(r["n"] for r in rows)
            mixer.weights[gates] = weights.reshape(mixer.weights.shape)[gates]
            mixer.hits += sum(np.frombuffer(r["hits"], "<f8") for r in rows).reshape(mixer.hits.shape)

    take(known.mapInArrow(learn, schema), slice(0, WORD_GATES))
    take(by_place(crossed.where("c > 0")).applyInPandas(learn_borders, schema), slice(WORD_GATES, GATES))
    return mixer


def by_place(crossed: DataFrame):
    """Borders grouped by place and last byte before: at most 65,536 in a group, at every size."""
    return crossed.groupBy(F.shiftright("code", 24), F.shiftright("code", 8).bitwiseAND(255))


def score_borders(crossed: DataFrame, mixer: Mixer) -> DataFrame:
    """``code`` and the model's ``log10p`` of distinct borders."""
    shared = crossed.sparkSession.sparkContext.broadcast((mixer.table, mixer.weights, mixer.hits))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mixer = Mixer(shared.value[0])
        mixer.weights, mixer.hits = shared.value[1:]
        group = Border(pdf["code"].to_numpy(np.int64), pdf["c"].to_numpy(), mixer.table, False)
        return pd.DataFrame({"code": pdf["code"], "log10p": group.log10_probability(mixer)})

    return by_place(crossed).applyInPandas(run, "code int, log10p double")


def score_words(words: DataFrame, mixer: Mixer) -> DataFrame:
    """``word``, ``c`` and the model's ``log10p`` of words (of their bytes after the first ``CROSS``) in units, ready."""
    import pyarrow as pa

    # plain arrays: executors need no copy of the package
    shared = words.sparkSession.sparkContext.broadcast((mixer.table, mixer.weights, mixer.hits))

    def run(batches):
        table, weights, hits = shared.value
        mixer = Mixer(table)
        mixer.weights, mixer.hits = weights, hits
        for words, counts, depth, so_far in whole_units(batches, False):
            p = mixer.log10_probability(words, depth, so_far, CROSS)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts), pa.array(p)], names=["word", "c", "log10p"])

    return words.mapInArrow(run, "word binary, c long, log10p double")


def score(docs: DataFrame) -> DataFrame:
    """Tokens, known tokens, base score and model score (both log10) and bits per byte (of the text's UTF-8 form; null if that is empty) of every document."""
    own = blocks(docs)
    pairs = own.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "x")).select("block", "place", F.col("x.words").alias("word"), F.col("x.train").alias("train"))
    words = stored(pairs.groupBy("word").agg(F.sum("train").alias("c")), "lm-words")
    totals = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"], totals["v"]
    known = ready(units(words))
    met = own.select("block", F.posexplode(F.arrays_zip("codes", "learned")).alias("place", "x")).select("block", "place", F.col("x.codes").alias("code"), F.col("x.learned").alias("learned"))
    crossed = stored(met.groupBy("code").agg(F.sum("learned").alias("c")), "lm-borders")
    mixer = fit(words, known, crossed)
    scored = score_words(known, mixer)
    # the distinct words grow with the input: never broadcast
    looked = pairs.select("block", "place", "word").join(scored.hint("merge"), "word").select(F.col("block").alias("of"), "place", "c", F.col("log10p").cast("float"))
    # a border has no count; its place is below 0
    over = met.join(score_borders(crossed, mixer), "code").select(F.col("block").alias("of"), (-1 - F.col("place")).alias("place"), F.lit(0).cast("long").alias("c"), F.col("log10p").cast("float"))
    looked = looked.unionByName(over)

    def per_byte(score, size):
        return pd.arrays.FloatingArray(-score / math.log10(2) / np.maximum(size, 1), size == 0)

    def add(bag: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("place")
        low = int((known["place"] < 0).sum())
        cross, known = known["log10p"].to_numpy(np.float64)[:low][::-1], known[low:]
        c, p = known["c"].to_numpy(), known["log10p"].to_numpy(np.float64)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

        def part(row) -> pd.DataFrame:
            def added(firsts, local, tf, *values):
                """Sums over each document of how often it has a number, and of these times each of the ``values``."""
                firsts, local, tf = np.frombuffer(firsts, "<i4"), np.cumsum(numbers(local), dtype=np.int32), numbers(tf)
                doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                return [np.bincount(doc, x, len(firsts) - 1) for x in (tf, *(tf * v[local] for v in values))]

            tokens, known, based, scored = added(row.firsts, row.local, row.tf, c > 0, base, p)
            scored = scored + added(row.border_firsts, row.border, row.border_tf, cross)[1]
            ids = pd.arrays.IntegerArray(np.frombuffer(row.ids, "<i8").copy(), np.frombuffer(row.null, bool).copy())
            return pd.DataFrame(
                {
                    "doc_id": ids, "held_out": np.frombuffer(row.held, bool), "n_tokens": tokens.astype(np.int64),
                    "n_known": known.astype(np.int64), "train_tokens": n,
                    "base_score": based, "score": scored, "bits_per_byte": per_byte(scored, numbers(row.sizes)),
                }
            )

        return pd.concat([part(row) for row in bag.itertuples()], ignore_index=True)

    bags = own.select("block", "ids", "null", "held", "sizes", "firsts", "local", "tf", "border_firsts", "border", "border_tf")
    return bags.groupBy("block").cogroup(looked.groupBy("of")).applyInPandas(
        add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )
