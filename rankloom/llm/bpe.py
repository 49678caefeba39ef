"""Exact BPE encoding by backtracking, and decoding by an offset table.

One Aho-Corasick pass over a word finds the longest token at every position.  The encoder
goes from left to right with the longest match; a token is taken only if the pair with its
left neighbour is compatible, that is, if merging would have left their border standing.
If no prefix of the match fits, the border is marked dead and the encoder steps back.  No
position is tried twice from the left, so a word takes linear time, and the result equals
the merges' result exactly.  Decoding gathers byte ranges of one blob of all token strings.

The vocabulary is a ``tokenizers`` JSON file with merges, an end-of-word suffix, and the
NFC, white-space and lower-case normalizers; its path is a parameter.  The driver reads it
and sends its content (fixed size) to the tasks.

Defined results: null and empty texts give no ids and an empty decoded text; repeated rows
are encoded each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from rankloom.llm.common import bound_batches, by_value, map_rows, utf8

by_value(__name__)

#: Stands for the end-of-word suffix inside words; private use, never the output of a byte.
END = "\ue000"
#: Words remembered per worker, and the longest that is remembered.
CACHE_WORDS = 200_000
CACHE_LENGTH = 48


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Coder:
    """Encoder and decoder built from the content of a vocabulary file."""

    def __init__(self, content: str):
        import ahocorasick
        import regex

        spec = json.loads(content)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a BPE vocabulary with an end-of-word suffix and without decoder is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = dict(enumerate(byte_letters()))

        inner = lambda token: token.removesuffix(suffix) + END if token.endswith(suffix) else token
        vocab = {inner(t): i for t, i in model["vocab"].items()}
        self.size = {i: len(t) for t, i in vocab.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[inner(right)], vocab[inner(left + right)]
            if c in self.parts:
                raise ValueError("two merges make the same token")
            self.parts[c], self.rank[c], self.merged[a, b] = (a, b), rank, rank
        # the next shorter token that starts a token
        self.shorter = {i: next((vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in vocab), None) for t, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()

        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        pieces = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
        self.offsets = np.cumsum([0, *map(len, pieces)])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.known_words: dict[str, bytes] = {}

    # ------------------------------------------------------------ encoding

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens: undo their merges, last first,
        and look for a merge across the border that would have come before."""
        if (known := self.known_pairs.get((left, right))) is not None:
            return known
        a, b, limit, fits = left, right, len(self.merged), True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                fits = False
                break
            # undo the later of the two merges; at equal rank the left one was made first
            if self.rank[a] > self.rank[b]:
                limit = self.rank[a]
                a = self.parts[a][1]
            elif self.rank[b] >= 0:
                limit = self.rank[b] + 1
                b = self.parts[b][0]
            else:
                break
        if len(self.known_pairs) >= 2_000_000:
            self.known_pairs.clear()
        self.known_pairs[left, right] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters with ``END`` after the last."""
        n = len(word)
        longest: list[int | None] = [None] * (n + 1)
        for end, (size, token) in self.automaton.iter(word):
            longest[end - size + 1] = token  # ends grow, so the last one is the longest
        live = bytearray(b"\1") * (n + 1)
        live[n - 1] = 0  # the end mark is no token of its own
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                if live[at + self.size[token]] and (not ids or self.compatible(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                ids.append(token)
                at += self.size[token]
                token = longest[at]
            elif ids:
                live[at] = 0
                token = ids.pop()
                at -= self.size[token]
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return ids

    def word_bytes(self, word: str) -> bytes:
        """Packed ids of a word as it stands in the text, remembered."""
        ids = self.encode_word(word.encode().decode("latin-1").translate(self.letters) + END)
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHE_LENGTH:
            if len(self.known_words) >= CACHE_WORDS:
                self.known_words.clear()
            self.known_words[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if self.special_pattern is None or "<" not in text:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter by itself, no final form
        known, new = self.known_words, self.word_bytes
        return b"".join([known.get(w) or new(w) for w in self.words(text.lower())])

    # ------------------------------------------------------------ decoding

    def decode(self, packed: bytes, block: int = 1 << 18) -> bytes:
        """UTF-8 text of packed ids: token strings joined by spaces, gathered block by block."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        out = []
        for at in range(0, len(ids), block):
            some = ids[at : at + block]
            start, size = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def coder_of(shared) -> Coder:
    """The worker's coder; built once per worker process, as the broadcast value stays."""
    value = shared.value
    if "coder" not in value:
        value["coder"] = Coder(value["content"])
    return value["coder"]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (packed) and ``decoded`` (UTF-8 bytes)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({"content": vocabulary(path)})
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        coder = coder_of(shared)
        for *kept, raws in batches:
            for *values, raw in zip(*kept, raws):
                packed = coder.encode(raw.decode("utf-8", "replace"))
                yield *values, packed, coder.decode(packed)

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_rows(docs.select(*keep, utf8(text).alias("_raw")), run, f"{ddl}, ids binary, decoded binary", rows=100)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, taken where they are made."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({"content": vocabulary(path)})

    def run(batches):
        coder = coder_of(shared)
        for ids, raws in batches:
            for doc_id, raw in zip(ids, raws):
                packed = coder.encode(raw.decode("utf-8", "replace"))
                yield doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(coder.decode(packed)).hexdigest()

    return map_rows(docs.select("doc_id", utf8()), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
