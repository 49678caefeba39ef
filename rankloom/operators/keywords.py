"""Which of many keywords does each text contain: one pass over a text, whatever their number."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# executors need pyahocorasick, but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keywords of one automaton, in UTF-8 bytes of all of them; more keywords take several passes.
MAX_KEYWORD_BYTES = 8 * 1024 * 1024
#: Result rows of one Arrow batch.
BATCH_ROWS = 50_000


def keyword_blocks(keywords: DataFrame | list[str], max_bytes: int) -> Iterator[list[str]]:
    """Distinct keywords in blocks of at most ``max_bytes`` (or of one keyword), fetched block by block."""
    if isinstance(keywords, list):
        rows = iter(sorted({k for k in keywords if k is not None}))
    else:
        name = keywords.columns[0]
        distinct = keywords.select(F.col(name).cast("string").alias("k")).where("k IS NOT NULL").distinct()
        rows = (r.k for r in distinct.toLocalIterator())
    block, size = [], 0
    for word in rows:
        n = len(word.encode()) + 1
        if block and size + n > max_bytes:
            yield block
            block, size = [], 0
        block.append(word)
        size += n
    if block:
        yield block


def automaton(words: list[str]):
    """Multi-pattern automaton of non-empty words; None if there are none."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for place, word in enumerate(words):
        if word:
            found.add_word(word, place)
    if not len(found):
        return None
    found.make_automaton()
    return found


def keyword_contains_join(
    df: DataFrame, text: str | Column, keywords: DataFrame | list[str], keep: list[str], max_bytes: int = MAX_KEYWORD_BYTES, *, lists: bool = False
) -> DataFrame:
    """``keep``, ``keyword``: a row for each input row and each distinct keyword that its text contains.

    The substring test is on code points and tells upper from lower case.  ``keywords`` is a list or a table whose first column
    holds them.  Each block of at most ``max_bytes`` of them is broadcast as plain text, and every Python task builds its
    automaton once; a text is read once per block, not once per keyword, and nothing is shuffled.  Input rows stay where they are, so
    repeated rows give repeated results.  Null texts and null keywords match nothing, the empty keyword is in every text
    that is not null.  Without keywords or rows the result is empty.  Only ``keep`` columns travel to Python; the column
    names ``keyword`` and ``_text`` are taken.  With ``lists`` the rows of one input row and one block come as one, with all their
    keywords as an array ``keyword``.
    """
    clash = {"keyword", "_text"} & set(keep)
    if clash:
        raise ValueError(f"column names {sorted(clash)} are taken")
    spark = df.sparkSession
    rows = df.select(*keep, (F.col(text) if isinstance(text, str) else text).cast("string").alias("_text"))
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in keep), T.StructField("keyword", T.ArrayType(T.StringType()) if lists else T.StringType())])
    out = None
    for words in keyword_blocks(keywords, max_bytes):
        part = rows.where(F.col("_text").isNotNull()).mapInArrow(matcher(spark.sparkContext.broadcast(words), schema, lists), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def matcher(shared, schema: T.StructType, lists: bool = False):
    """The function of one Python task: batches of ``keep`` and ``_text`` in, matches out."""
    target = to_arrow_schema(schema)

    def flush(batch: pa.RecordBatch, sizes: list[tuple[int, int]], found: list[int], words: pa.Array) -> pa.RecordBatch:
        rows, n = np.array(sizes, np.int64).reshape(-1, 2).T
        taken = words.take(pa.array(found, pa.int64()))
        if lists:
            firsts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            taken = pa.ListArray.from_arrays(pa.array(firsts), taken)
        kept = batch.take(pa.array(rows if lists else np.repeat(rows, n)))
        columns = [kept.column(i).cast(target[i].type) for i in range(len(target) - 1)]
        return pa.RecordBatch.from_arrays([*columns, taken.cast(target[-1].type)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        trie = automaton(words)
        always = [i for i, w in enumerate(words) if not w]
        known = pa.array(words, pa.string())
        for batch in batches:
            sizes, found = [], []
            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                hits = {i for _, i in trie.iter(value.as_py())} if trie is not None else ()
                if hits or always:
                    sizes.append((row, len(hits) + len(always)))
                    found.extend(hits)
                    found.extend(always)
                if len(found) >= BATCH_ROWS:
                    yield flush(batch, sizes, found, known)
                    sizes, found = [], []
            if found:
                yield flush(batch, sizes, found, known)

    return run
