"""Document fingerprints by spot signatures.

A common word (the anchor) and the chain of the next ``CHAIN`` content words, common words left
out, are one signature; a text's fingerprint is the set of its signatures.  Common words
carry the natural flow of a text, lists and navigation hold few of them, so signatures sit
where the text is.  Two texts are alike by the Jaccard measure of their sets.

:func:`near_texts` joins a table with itself.  Sets are partitioned by length so that a
pair at the threshold lies in one partition or two neighbouring ones.  Inside, an inverted index over the
rarest signatures of every set (as many as a pair at the threshold must share one of) gives
candidates; lengths prune them, a pair is measured at its first common index entry only, and the
measure is exact.  Large index entries are dealt out as pairs of blocks; links are counted and spanned,
never listed.

:func:`edited_report` compares each text with an edited version that ends in the beginning of the next
document.  Documents are dealt into ranges of the order (doc_id descending) and sorted there; the
first row of a range also goes to the range before, so every row meets its successor in one shuffle of
compressed texts.  A bounded sample of keys chooses the ranges' borders and nothing else.

Defined results: null text is empty and has no signatures; a text without common words takes each of its
words as an anchor, one of common words only chains those, one without words is one signature; a chain ends early at the
text's end; two empty sets are alike (1.0), an empty and another are not (0.0); rows without an id come
after all others, rows of equal id in the order of their texts' hashes; repeated rows count as
documents of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, by_value, map_rows, stored, utf8
from rankloom.llm.components import components
from rankloom.llm.near_copies import forest_edges, intersections, mixed, set_name

by_value(__name__)

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    word.encode()
    for word in (
        "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "his",
        "if", "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "there", "they", "this", "to", "was", "we", "were",
        "will", "with", "you",
        "aber", "als", "am", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "durch", "ein", "eine", "einen", "er",
        "es", "für", "im", "ist", "mit", "nach", "nicht", "oder", "sich", "sie", "sind", "und", "von", "war", "wie", "wird", "zu", "zum", "zur",
        "au", "aux", "avec", "ce", "cette", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "mais", "ne", "nous", "ont",
        "ou", "par", "pas", "pour", "que", "qui", "sa", "se", "ses", "son", "sont", "sur", "un", "une",
        "al", "como", "con", "del", "el", "era", "esta", "este", "ha", "las", "lo", "los", "más", "no", "para", "pero", "por", "su", "sus", "una", "y",
    )
)
#: With its anchor a signature holds five words.
CHAIN = 4
THRESHOLD = 0.8
BLOCK = 512
RANGE_BYTES = 32 << 20
MAX_RANGES = 20_000
SAMPLE_ROWS = 200_000
#: Bytes of words: letters in lower case, digits and everything beyond ASCII; the rest is a gap.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# ---------------------------------------------------------------- signatures


class Signatures:
    """Sorted signature sets (64 bits each) of texts; remembers the hashes of words."""

    def __init__(self, chain: int = CHAIN, anchors: frozenset[bytes] = ANCHORS):
        self.chain, self.anchors = chain, anchors
        self.known: dict[bytes, int] = {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(chain + 1)], np.uint64)

    def word(self, word: bytes) -> int:
        """Hash of a word; odd for anchors."""
        if len(self.known) > 500_000:
            self.known.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1 << 1 | (word in self.anchors)
        self.known[word] = h = h or 2
        return h

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.translate(WORD_BYTES).split()
        if not words:
            return np.array([self.word(raw)], np.uint64) if raw else np.zeros(0, np.uint64)
        known, new = self.known, self.word
        h = np.array([known.get(w) or new(w) for w in words], np.uint64)
        common = (h & np.uint64(1)).astype(bool)
        content = h[~common]
        if not len(content):  # common words only: they are the content
            content, common = h, np.zeros(len(h), bool)
        if common.any():
            starts, anchors = np.cumsum(~common)[common], h[common]
            full = starts < len(content)
            starts, anchors = starts[full], anchors[full]
        if not common.any() or not len(starts):
            starts, anchors = np.arange(len(content)), np.zeros(len(content), np.uint64)
        padded = np.concatenate([content, np.zeros(self.chain, np.uint64)])
        out = mixed(anchors ^ self.powers[0]) * self.powers[0]
        for i in range(self.chain):
            out += mixed(padded[starts + i] ^ self.powers[i + 1]) * self.powers[i + 1]
        return np.unique(mixed(out) >> np.uint64(16))  # 48 bits: eight characters of the fingerprint


def fingerprint(signatures: np.ndarray) -> str:
    """Eight characters for each signature, in ascending order of the signatures."""
    return base64.b64encode(signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard measure of two sorted sets; 0.0 without comparing them if their lengths rule ``least`` out."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    if short < least * long:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (short + long - common)


# ---------------------------------------------------------------- edited texts


def ordered_key(docs: DataFrame) -> DataFrame:
    """``last`` (no id), ``place`` (ascending for descending ids) and ``h``: the order of documents; ``doc_id``; ``text`` as bytes."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.isNull().alias("last"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("place"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), doc_id.alias("doc_id"), utf8(),
    )


def borders(keyed: DataFrame, rows: int, range_bytes: int = RANGE_BYTES) -> list[tuple[bool, int, int]]:
    """Keys that cut the order into ranges of about ``range_bytes`` of text."""
    sample = keyed.select("last", "place", "h", F.octet_length("text").alias("n"))
    if rows > SAMPLE_ROWS:
        sample = sample.sample(SAMPLE_ROWS / rows, seed=11)
    found = sample.toArrow()
    keys = sorted(zip(*(found.column(i).to_pylist() for i in range(4))))
    size = sum(k[3] for k in keys)
    if not size:
        return []
    ranges = size / len(keys) * rows / range_bytes
    least = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = size / min(MAX_RANGES, max(least, ranges))
    cuts, reached = [], 0.0
    for last, place, h, n in keys:
        reached += n
        if reached >= step:
            cuts.append((last, place, h))
            reached = 0.0
    return sorted(set(cuts))


def with_next(docs: DataFrame, function, schema: str) -> DataFrame:
    """``function`` turns an iterator of (doc_id, text, next document's text; bytes) into rows."""
    bound_batches(docs.sparkSession)
    keyed = ordered_key(docs)
    rows = docs.count()
    cuts = borders(keyed, rows)

    def first_keys(batches):
        first = {}
        for columns in batches:
            for key in zip(*columns):
                part = bisect_right(cuts, key)
                if part not in first or key < first[part]:
                    first[part] = key
        yield from ((part, *key) for part, key in first.items())

    firsts = map_rows(keyed.select("last", "place", "h"), first_keys, "part int, last boolean, place long, h long")
    firsts = firsts.groupBy("part").agg(F.min(F.struct("last", "place", "h")).alias("k")).collect()  # one row per range
    first = {r.part: tuple(r.k) for r in firsts}
    parts = sorted(first)
    before = dict(zip(parts, parts[-1:] + parts[:-1]))

    def deal(batches):
        for columns in batches:
            for last, place, h, doc_id, raw in zip(*columns):
                part = bisect_right(cuts, (last, place, h))
                row = (last, place, h, doc_id, len(raw), pa.compress(raw, "zstd", asbytes=True))
                yield part, False, *row
                if first[part] == (last, place, h):
                    yield before[part], True, *row

    columns = "part int, borrowed boolean, last boolean, place long, h long, doc_id long, n long, text binary"
    dealt = map_rows(keyed, deal, columns, rows=500).repartition(max(len(parts), 1), "part")
    dealt = dealt.sortWithinPartitions("part", "borrowed", "last", "place", "h", "text")

    def successive(batches):
        at, own = None, None  # own: the row that waits for its successor
        for columns in batches:
            for part, borrowed, _, _, _, doc_id, n, raw in zip(*columns):
                if own is None and borrowed:  # the range's last row has met its successor
                    continue
                text = pa.decompress(raw, n, "zstd", asbytes=True) if n else b""
                if own is not None and at == part:
                    yield *own, text
                at, own = part, None if borrowed else (doc_id, text)

    def run(batches):
        return function(successive(batches))

    return map_rows(dealt, run, schema, rows=500)


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited version, and how alike the text is to that and to the next document."""

    def run(rows):
        signatures, carried = Signatures(), (None, None)
        for doc_id, raw, after in rows:
            own = carried[1] if carried[0] == raw else signatures(raw)
            carried = (after, signatures(after))
            text = raw.decode("utf-8", "replace")
            n = len(text)
            edited = (text[: n - n // 3] + after[: 4 * (n // 3)].decode("utf-8", "ignore")[: n // 3]).encode()
            changed = signatures(edited)
            yield (
                doc_id, n, hashlib.sha256(edited).hexdigest(), fingerprint(own), fingerprint(changed),
                likeness(own, changed), likeness(own, carried[1]),
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, run, schema)


# ---------------------------------------------------------------- join


def length_borders(threshold: float, longest: int) -> list[int]:
    """First lengths of the partitions: sets of one partition, or of two neighbours, can reach the threshold."""
    out = [1]
    while out[-1] <= longest:
        out.append(int(out[-1] / threshold + 1e-9) + 1)
    return out


def shared_needed(n: int, threshold: float) -> int:
    """Signatures that a set of length ``n`` must share with any set at the threshold."""
    return int(np.ceil(threshold * n - 1e-9))


def measure(a: list[tuple], b: list[tuple], same: bool, threshold: float):
    """Links between two blocks of (node, copies, prefix before this entry, set), the pair's first common entry being this one."""
    if not a or not b:
        return
    n_a, n_b = (np.array([len(r[3]) for r in x], np.float64) for x in (a, b))
    fits = np.minimum(n_a[:, None], n_b) >= threshold * np.maximum(n_a[:, None], n_b) - 1e-9
    fits &= intersections([r[2] for r in a], [r[2] for r in b]) == 0
    if same:
        np.fill_diagonal(fits, False)
    rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    linked = np.zeros(fits.shape, bool)
    if len(rows) and len(columns):
        common = intersections([a[i][3] for i in rows], [b[i][3] for i in columns]).astype(np.float64)
        linked[np.ix_(rows, columns)] = common >= threshold * (n_a[rows, None] + n_b[columns] - common) - 1e-9
    linked &= fits
    w_a, w_b = (np.array([r[1] for r in x], np.int64) for x in (a, b))
    sides = [(linked @ w_b, a)] if same else [(linked @ w_b, a), (linked.T @ w_a, b)]
    for links, side in sides:
        yield from ((row[0], int(k), None) for k, row in zip(links.tolist(), side) if k)
    if same:
        full, every = linked, a
    else:
        full, every = np.zeros((len(a) + len(b),) * 2, bool), a + b
        full[: len(a), len(a) :], full[len(a) :, : len(a)] = linked, linked.T
    yield from ((every[i][0], 0, every[j][0]) for i, j in forest_edges(full))


def near_texts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``class_id`` (least id of its component of alike texts) and ``n_links`` of every document."""
    bound_batches(docs.sparkSession)

    def sets(batches):
        signatures = Signatures()
        for ids, raws in batches:
            for doc_id, raw in zip(ids, raws):
                s = signatures(raw)
                yield (doc_id, set_name(s), s.astype(np.int64).tolist()) if len(s) else (doc_id, None, None)

    named = stored(map_rows(docs.select(F.col("doc_id").cast("long"), utf8()), sets, "doc_id long, node binary, s array<long>", rows=500), "spots")
    own = named.where("node is not null")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("s").alias("s"))
    nodes = stored(nodes, "spot-sets")
    lists = nodes.select("node", F.explode("s").alias("sig"))
    ranked = lists.join(lists.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    ranked = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("rare"))

    longest = nodes.agg(F.max(F.size("s"))).first()[0] or 0
    cuts = length_borders(threshold, longest)

    def index(batches):
        """Index entries: the rarest signatures, in the set's own partition and, for the shorter sets, the next."""
        for nodes_, copies, rares in zip_batches(batches):
            n = len(rares)
            part = bisect_right(cuts, n) - 1
            order = [r["sig"] for r in rares]
            for i in range(n - shared_needed(n, threshold) + 1):
                if rares[i]["df"] > 1:
                    yield nodes_, copies, part, True, order[i], order[:i], n
                    yield nodes_, copies, part + 1, False, order[i], order[:i], n

    def zip_batches(batches):
        for columns in batches:
            yield from zip(*columns)

    entries = map_rows(
        ranked.join(nodes.select("node", "copies"), "node").select("node", "copies", "rare"),
        index, "node binary, copies long, part int, home boolean, sig long, prior array<long>, n int", rows=500,
    )
    entries = stored(entries, "spot-index")
    sizes = entries.groupBy("part", "sig").agg(F.count("*").alias("members"), F.count_if("home").alias("homes")).where("members > 1 and homes > 0")
    entries = entries.join(sizes.drop("homes"), ["part", "sig"])
    entries = entries.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    key = ["part", "sig", "i", "j"]
    pairs = entries.join(nodes.select("node", "s"), "node").withColumn("pair", F.explode(others))
    pairs = pairs.select("part", "sig", "pair.i", "pair.j", "block", "home", "node", "copies", "prior", "s")
    pairs = pairs.repartition(*key).sortWithinPartitions(*key, "block", "node")

    def check(batches):
        last, group = None, []
        for part, sig, i, j, block, home, node, copies, prior, s in zip_batches(batches):
            if (part, sig, i, j) != last:
                yield from settled(last, group)
                last, group = (part, sig, i, j), []
            group.append((block, home, (node, copies, np.sort(np.array(prior, np.uint64)), np.sort(np.array(s, np.uint64)))))
        yield from settled(last, group)

    def settled(last, group):
        if len(group) < 2:
            return
        _, _, i, j = last
        if i == j:  # homes among themselves, and with the shorter sets of this block
            homes = [r for _, home, r in group if home]
            yield from measure(homes, homes, True, threshold)
            yield from measure(homes, [r for _, home, r in group if not home], False, threshold)
            return
        one, two = ([(h, r) for b, h, r in group if b == k] for k in (i, j))
        homes_one, homes_two = ([r for h, r in x if h] for x in (one, two))
        yield from measure(homes_one, homes_two, False, threshold)
        yield from measure(homes_one, [r for h, r in two if not h], False, threshold)
        yield from measure(homes_two, [r for h, r in one if not h], False, threshold)

    found = stored(map_rows(pairs, check, "a binary, links long, b binary"), "spot-links")
    classes = components(found.where("b is not null").select("a", "b"))
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = nodes.drop("s").join(classes, "node", "left").join(counted, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("class_id"))
    joined = joined.join(least, "component").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = own.select("doc_id", "node").join(joined, "node").select("doc_id", "class_id", "n_links")
    alone = named.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)
