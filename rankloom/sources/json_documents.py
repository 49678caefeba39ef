"""Records of JSON documents: the list at the top, or the one under ``candidates``, read by all cores.

Fragments end at closing braces, so even a document on one line has many.  The first pass gives each split's quotes
and bracket depth for both states it may begin in; the second finds where the list begins and ends
and counts its commas; the third cuts the elements.  What stands around the list is joined per
document and must be JSON itself.
"""

from __future__ import annotations

import re
import sys
from urllib.parse import unquote

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.json_text import is_json
from rankloom.sources import split_scan as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BRACE = b"}"
ESCAPE = re.compile(rb"\\.", re.S)
KEY = re.compile(rb'"candidates"[\x20\t\r\n]*:[\x20\t\r\n]*(.?)', re.S)
BLANK = b" \t\r\n"


def inside_strings(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``text`` and which of them belong to a string (the opening quote does, the closing one does not)."""
    plain = np.frombuffer(ESCAPE.sub(b"  ", text), np.uint8)
    return plain, ((np.cumsum(plain == ord('"')) + inside) & 1).astype(bool)


def bracket_steps(plain: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """+1 for an opening bracket, -1 for a closing one, outside of strings."""
    opens = (plain == ord("{")) | (plain == ord("["))
    closes = (plain == ord("}")) | (plain == ord("]"))
    return np.where(hidden, 0, opens.astype(np.int8) - closes.astype(np.int8))


class Fragments:
    """The text of a split, fragment lists at a time, with the separators put back between them."""

    def __init__(self, last_brace: bool = False):
        self.begun, self.last_brace = False, last_brace

    def text(self, raws: list[bytes]) -> bytes:
        begun, self.begun = self.begun, True
        return (BRACE if begun else b"") + BRACE.join(raws)

    def last(self) -> bytes:
        return BRACE if self.begun and self.last_brace else b""


class Summary:
    """Quotes and depth of a split, for a start outside and inside of a string."""

    SCHEMA = "source_file string, split_start long, file_size long, n_bytes long, n_parts long, quotes long, outside long, inside long, first string"

    def __init__(self, file: str, start: int, size: int):
        self.key, self.parts, self.bytes, self.n = (file, start, size), Fragments(), 0, 0
        self.quotes, self.depth, self.first = 0, [0, 0], None

    def feed(self, raws):
        text = self.parts.text(raws)
        self.bytes += sum(map(len, raws))
        self.n += len(raws)
        for state in (0, 1):
            plain, hidden = inside_strings(text, bool((self.quotes + state) & 1))
            self.depth[state] += int(bracket_steps(plain, hidden).sum())
        self.quotes += int((plain == ord('"')).sum())
        if self.first is None and (seen := text.strip(BLANK)):
            self.first = chr(seen[0])
        return ()

    def end(self):
        yield *self.key, self.bytes, self.n, self.quotes, *self.depth, self.first


class Walk:
    """Positions that matter in a split whose start state is known."""

    def __init__(self, key: tuple, inside: bool, depth: int, level: int, last_brace: bool):
        self.key, self.inside, self.depth, self.level = key, inside, depth, level
        self.parts = Fragments(last_brace)

    def events(self, text: bytes) -> list[tuple[int, str]]:
        """(position, kind) in order: ``open`` after the list's bracket, ``comma`` and ``close`` at its level, ``bad``."""
        plain, hidden = inside_strings(text, self.inside)
        if not len(plain):
            return []
        steps = bracket_steps(plain, hidden)
        depth = self.depth + np.cumsum(steps)
        found = [(int(i), "comma") for i in np.flatnonzero((plain == ord(",")) & ~hidden & (depth == self.level))]
        found += [(int(i), "close") for i in np.flatnonzero((steps < 0) & (depth == self.level - 1))]
        if self.level == 1:
            found += [(int(i) + 1, "open") for i in np.flatnonzero((steps > 0) & (depth == 1))]
        else:
            for m in KEY.finditer(text):
                i = m.start()
                if hidden[i] and plain[i] == ord('"') and depth[i] == 1:
                    found.append((m.end(), "open") if m.group(1) == b"[" else (i, "bad"))
        self.inside, self.depth = bool(hidden[-1]), int(depth[-1])
        return sorted(found, key=lambda e: (e[0], e[1] != "open"))  # an empty list closes where it opens


class Outline(Walk):
    """Where the list begins and ends in a split, and its commas for either state at the start."""

    SCHEMA = "source_file string, split_start long, head long, closed boolean, opened long, tail long, still_open boolean, bad boolean"

    def __init__(self, *state):
        super().__init__(*state)
        self.head, self.closed, self.opened, self.tail, self.open, self.bad = 0, False, 0, 0, False, False

    def note(self, text):
        for _, kind in self.events(text):
            if kind == "open":
                self.opened, self.open = self.opened + 1, True
            elif kind == "bad":
                self.bad = True
            elif kind == "close":
                self.closed, self.open = self.closed or not self.opened, False
            elif self.open:
                self.tail += 1
            elif not self.closed and not self.opened:
                self.head += 1
        return ()

    def feed(self, raws):
        return self.note(self.parts.text(raws))

    def end(self):
        self.note(self.parts.last())
        yield *self.key, self.head, self.closed, self.opened, self.tail, self.open, self.bad


class Elements(Walk):
    """The list's elements, numbered from 1, and (as record 0) what stands around the list."""

    def __init__(self, key, inside, depth, level, last_brace, in_list: bool, before: int, alone: bool):
        super().__init__(key, inside, depth, level, last_brace)
        self.in_list, self.record, self.whole, self.held, self.part = in_list, before + 1, False, [], 0
        self.alone = alone  # no comma in the list: it is empty if there is no text either

    def piece(self, text: bytes, whole: bool):
        held, self.held, self.part = b"".join([*self.held, text]), [], self.part + 1
        if not (self.in_list and self.alone and not held.strip(BLANK)):
            yield self.key[0], self.record if self.in_list else 0, self.key[1], 0 if whole else self.part, whole, held

    def cut(self, text):
        at = 0
        for i, kind in self.events(text):
            if kind == "open":
                yield from self.piece(text[at:i], False)
                self.in_list, self.record, self.whole, at = True, 1, True, i
            elif self.in_list and kind in ("comma", "close"):
                yield from self.piece(text[at:i], self.whole)
                self.record, self.whole, at = self.record + 1, True, i + (kind == "comma")
                self.in_list = kind == "comma"
        self.held.append(text[at:])

    def feed(self, raws):
        return self.cut(self.parts.text(raws))

    def end(self):
        yield from self.cut(self.parts.last())
        yield from self.piece(b"", False)


def plain_name(file: str) -> str:
    """A file's name, however its scheme's slashes are written."""
    return re.sub(r"^(\w+):/+", r"\1:", unquote(file))


def read_elements(spark: SparkSession, path: str | list[str], mode: str) -> DataFrame:
    """``source_file, row_id, raw`` of all list elements; malformed documents stop the job or stay out (see :func:`faults`)."""
    found = S.fragments(spark, path, BRACE.decode())
    states, levels, bad = {}, {}, set()
    files = S.by_file(S.per_split(found, Summary, Summary.SCHEMA).collect())
    for name, splits in files.items():
        first = next((s.first for s in splits if s.first), None)
        level = {"[": 1, "{": 2}.get(first)
        inside, depth = False, 0
        for s in splits:
            states[name, s.split_start] = [inside, depth]
            depth += s.inside if inside else s.outside
            inside ^= bool(s.quotes & 1)
            depth -= s is not splits[-1] and not inside  # the brace at the split's end
        size, n = sum(s.n_bytes for s in splits), sum(s.n_parts for s in splits)
        # fragments do not tell whether the file ends with a brace: its size does, or (compressed) its depth
        brace = size + n == splits[0].file_size if splits[0].file_size in (size + n, size + n - 1) else depth == 1
        levels[name] = (level, brace, splits[-1].split_start)
        if level is None or inside or depth != brace:
            bad.add(name)
    # an empty file has no fragments, and is no document
    listed_files = found.inputFiles()
    if len(listed_files) > len(files):
        seen = {plain_name(name) for name in files}
        bad |= {name for name in listed_files if plain_name(name) not in seen}

    def outline(file, start, size):
        level, brace, last = levels[file]
        return None if file in bad else Outline((file, start), *states[file, start], level, brace or start != last)

    for name, splits in S.by_file(S.per_split(found, outline, Outline.SCHEMA).collect()).items():
        in_list, before, opened = False, 0, 0
        for s in splits:
            states[name, s.split_start] += [in_list, before]
            before += (s.head if in_list else 0) + s.tail
            in_list = s.still_open if s.opened else in_list and not s.closed
            opened += s.opened
            if s.bad:
                bad.add(name)
        if opened > 1 or (levels[name][0] == 1 and opened != 1):
            bad.add(name)
        levels[name] += (before == 0,)
    if bad and mode == "FAILFAST":
        raise ValueError(f"Invalid JSON document {min(bad)}: it must be a list, or an object with a list under candidates")

    def elements(file, start, size):
        if file in bad:
            return None
        level, brace, last, alone = levels[file]
        inside, depth, in_list, before = states[file, start]
        return Elements((file, start), inside, depth, level, brace or start != last, in_list, before, alone)

    pieces = S.whole_records(S.per_split(found, elements, S.PIECES))
    listed = pieces.where("record > 0").withColumn("raw", F.trim(F.col("raw"), F.lit(" \t\r\n")))
    good = is_json(F.col("raw"))
    name = F.concat(F.lit("Invalid JSON document "), F.col("source_file"))
    if mode == "FAILFAST":
        listed = listed.where(F.when(~good, F.raise_error(F.concat(name, F.lit(": element "), F.col("record").cast("string")))).otherwise(F.lit(True)))
        # raised by reading the row's text, which every use of the records does; else no object and left out
        text = F.when((F.col("record") > 0) | is_json(F.col("raw")), F.lit("")).otherwise(F.raise_error(name))
        stop = pieces.where("record = 0").select("source_file", "record", text.alias("raw"))
        listed = listed.unionByName(stop)
    else:
        around = pieces.where((F.col("record") == 0) & ~is_json(F.col("raw"))).select("source_file")
        listed = listed.join(listed.where(~good).select("source_file").unionByName(around).distinct(), "source_file", "left_anti")
    return listed.select("source_file", F.col("record").alias("row_id"), "raw")
