"""Token ids of documents as one binary column (2 bytes an id where the vocabulary allows, else 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.common import ship
from potable.llm.shingles import row_slices
from potable.llm.word_tokens import word_tokens
from potable.llm.workers import over_batches

OUT_BYTES = 4 << 20
#: stands for a null id in files and orders
NULL_ID = -(1 << 63)


def id_width(tokenizer_path: str) -> int:
    return 2 if word_tokens(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def ids_of(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{width}")


def encoded(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bounds: list[int] | None = None
) -> DataFrame:
    """(part, doc_id, tie, ids): every whole text's ids and ``end_id``; ``tie`` orders rows of equal ids.

    ``part`` is the number of ``bounds`` below the id (nulls come first). A null
    text counts as empty. Other columns are not read.
    """
    edges = np.array(bounds or [], dtype=np.int64)
    ship(docs.sparkSession)
    width = id_width(tokenizer_path)

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            for at, part in row_slices(batch.column(2), OUT_BYTES):
                blobs = [np.append(ids, end_id).astype(f"<u{width}").tobytes() for ids in tokens.encode_texts(part.to_pylist())]
                rows = batch.slice(at, len(part))
                names = rows.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                part = pa.array(np.searchsorted(edges, names, side="left").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part, rows.column(0), rows.column(1), pa.array(blobs, pa.binary())], ["part", "doc_id", "tie", "ids"]
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, tie long, ids binary")
