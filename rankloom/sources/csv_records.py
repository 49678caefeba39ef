"""CSV records whose cells may hold line breaks, cut in parallel at true record ends.

Whether a line break ends a record depends on the quotes before it.  The first pass counts each split's quotes and the
records that end in it, for a start outside and inside of a quoted cell; chained in file order these give every split's
state and the number of its first record.  The second pass cuts and parses the records.
"""

from __future__ import annotations

import csv
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources import split_scan as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "source_file string, record long, cells array<string>, raw string"


class Ends:
    """Quotes of a split, and the records that end in it for either state at its start; blank lines are none."""

    SCHEMA = "source_file string, split_start long, quotes long, outside long, inside long"

    def __init__(self, file, start, quote: bytes):
        self.key, self.quote, self.quotes, self.ends, self.begun = (file, start), quote, 0, [0, 0], [False, True]

    def feed(self, raws):
        for raw in raws:
            self.quotes += raw.count(self.quote)
            text = not raw.isspace() and bool(raw)
            for state in (0, 1):
                if (self.quotes + state) & 1:
                    self.begun[state] = True
                else:
                    self.ends[state] += text or self.begun[state]
                    self.begun[state] = False
        return ()

    def end(self):
        yield *self.key, self.quotes, *self.ends


class Cells:
    """A split's records, numbered in the file; pieces of those that cross its borders."""

    def __init__(self, file, start, quote: bytes, inside: bool, before: int):
        self.file, self.start, self.quote = file, start, quote
        self.inside, self.record, self.held, self.whole = inside, before, [], not inside

    def feed(self, raws):
        for raw in raws:
            self.inside ^= bool(raw.count(self.quote) & 1)
            if self.inside or self.held or not self.whole:
                self.held.append(raw)
            elif raw and not raw.isspace():
                yield self.file, self.record, self.start, 0, True, raw
                self.record += 1
            if not self.inside and (self.held or not self.whole):
                # a piece that goes on in the next split keeps the line break that ended it
                yield self.file, self.record, self.start, 0, self.whole, b"\n".join(self.held)
                self.record, self.held, self.whole = self.record + 1, [], True

    def end(self):
        if self.inside:
            yield self.file, self.record, self.start, 1, False, b"\n".join(self.held) + b"\n"


def parsed(records: DataFrame, sep: str, quote: str) -> DataFrame:
    """``source_file, record, cells, raw`` of record texts; empty cells are null."""

    def run(batches):
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            files, numbers, raws = (c.to_pylist() for c in batch.columns)
            texts = [r.removesuffix("\n").removesuffix("\r") for r in raws]
            rows = csv.reader(texts, delimiter=sep, quotechar=quote)
            cells = [[c if c != "" else None for c in row] for row in rows]
            yield S.batch_of(list(zip(files, numbers, cells, raws)), target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(ROWS))
    return records.mapInArrow(run, ROWS)


def read_records(spark: SparkSession, path: str | list[str], sep: str, quote: str) -> tuple[DataFrame, dict[str, int]]:
    """All records (number 0 is the first of a file), and for each file that ends inside a quoted cell the record that does not end."""
    lines = S.fragments(spark, path, "\n")
    mark = quote.encode()
    states, unclosed = {}, {}
    for name, splits in S.by_file(S.per_split(lines, lambda f, s, _: Ends(f, s, mark), Ends.SCHEMA).collect()).items():
        inside, before = False, 0
        for s in splits:
            states[name, s.split_start] = inside, before
            before += s.inside if inside else s.outside
            inside ^= bool(s.quotes & 1)
        if inside:
            unclosed[name] = before
    pieces = S.per_split(lines, lambda f, s, _: Cells(f, s, mark, *states[f, s]), S.PIECES)
    return parsed(S.whole_records(pieces), sep, quote), unclosed


def cell_type(text: Column) -> Column:
    """0 for a null, 1 for a whole number, 2 for a number, 3 for a truth value, 4 for other text."""
    trimmed = F.trim(text)
    return (
        F.when(text.isNull(), 0)
        .when(trimmed.rlike(r"^[+-]?[0-9]{1,18}$"), 1)
        .when(trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), 2)
        .when(F.lower(trimmed).isin("true", "false"), 3)
        .otherwise(4)
    )


def column_types(records: DataFrame, width: int) -> list[str]:
    """The narrowest type that every cell of a column fits, from one aggregate over all records."""
    if not width:
        return []
    kinds = [cell_type(F.get("cells", F.lit(i))) for i in range(width)]
    seen = records.agg(*[F.struct(F.max(k).alias("high"), F.bool_or(k == 3).alias("truth"), F.bool_or(k.isin(1, 2)).alias("number")).alias(f"c{i}") for i, k in enumerate(kinds)])
    out = []
    for high, truth, number in seen.first():
        kind = {1: "bigint", 2: "double", 3: "boolean"}.get(high, "string")
        out.append("string" if truth and number else kind)
    return out


def faults(records: DataFrame, width: int, unclosed: dict[str, int]) -> Column:
    """Why a record is malformed; null for a good one."""
    n = F.size("cells")
    reason = F.when(n > width, F.concat(n.cast("string"), F.lit(f" cells for {width} columns")))
    for file, record in unclosed.items():
        reason = F.when((F.col("source_file") == file) & (F.col("record") == record), F.lit("a quote is never closed")).otherwise(reason)
    return reason
