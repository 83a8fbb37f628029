"""Byte n-grams of documents and interpolated modified Kneser-Ney estimates.

A document's stream is its words (A-Z lower-cased) joined by single spaces, with a
start mark before and an end mark behind. An n-gram of order ``k`` is the integer of
its ``k`` bytes, so a gram's context is ``gram >> 8`` and its suffix is its low bytes.

Order ``n`` uses counts of occurrences; each lower order uses the number of
different grams one byte longer that end in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.shingles import row_slices
from potable.llm.workers import over_batches

#: start and end mark; white space inside a stream is always a blank
MARK = "\n"
SYMBOLS = 256
SLICE_BYTES = 4 << 20


def stream(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all streams one after another, and where each begins (and the end)."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    joined = pc.binary_join(words, " ")
    marked = pc.binary_join_element_wise(MARK * (order - 1), joined, MARK, "")
    if isinstance(marked, pa.ChunkedArray):
        marked = marked.combine_chunks()
    edges = np.frombuffer(marked.buffers()[1], dtype=np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    data = np.frombuffer(marked.buffers()[2] or b"", dtype=np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def windows(data: np.ndarray, edges: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams at all places, which of them lie inside one stream, and the first such of each text (and the end)."""
    n = max(len(data) - order + 1, 0)
    codes = np.zeros(n, dtype=np.int64)
    for i in range(order):
        codes = (codes << 8) | data[i : i + n]
    inside = np.ones(n, dtype=bool)
    # windows that begin in the last bytes of a stream reach into the next one
    for back in range(1, order):
        at = edges[1:-1] - back
        inside[at[at >= 0]] = False
    return codes, inside, edges - np.arange(len(edges)) * (order - 1)


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order-``order`` gram that ends at each predicted byte, and the first of each text (and the end)."""
    codes, inside, first = windows(*stream(texts, order), order)
    return codes[inside], first


def text_grams(texts: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, grams, first gram of each text and the end), a slice at a time."""
    for at, part in row_slices(texts, SLICE_BYTES):
        codes, first = grams(part, order)
        yield at, codes, first


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n) over ``docs`` = (text, counted): every gram that occurs, with its occurrences in counted texts.

    Sums are made inside each task first.
    """

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.Series(dtype=np.int64)
        for batch in batches:
            counted = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for at, codes, first in text_grams(batch.column(0), order):
                size = np.diff(first)
                code, found = pd.factorize(codes)
                own = np.bincount(code[np.repeat(counted[at : at + len(size)], size)], minlength=len(found))
                new = pd.Series(own.astype(np.int64), index=found)
                held = held.add(new, fill_value=0) if len(held) else new
                if len(held) > MOST_HELD:
                    yield _rows(held)
                    held = pd.Series(dtype=np.int64)
        if len(held):
            yield _rows(held)

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


#: distinct grams a counting task holds before it passes its sums on
MOST_HELD = 2_000_000


def _rows(held: pd.Series) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.index.to_numpy(np.int64)), pa.array(held.to_numpy(np.int64))], ["gram", "n"]
    )


def shorter(table: DataFrame, order: int) -> DataFrame:
    """Continuation counts of order ``order`` from the distinct grams one byte longer."""
    low = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))
    return table.groupBy(low.alias("gram")).agg(F.count("*").alias("n"))


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from n1..n4.

    Where a count of counts is zero the formula has no value; half a count is taken.
    """
    n1, n2, n3, n4 = counts_of_counts
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, d1), (2, d2), (3, d3)))  # type: ignore[return-value]
