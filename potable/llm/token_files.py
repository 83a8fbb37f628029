"""Token-id files of patched frame-of-reference blocks.

File format (little-endian). A file is a run of segments in ascending ``doc_id``
order; a segment is one self-contained image of whole documents:

====================  =======================================================
``PFR1``              magic
``u32 x 3, u64``      documents, blocks, ids per block, ids of the file before
``i64[documents]``    doc_id (a null id is the smallest 64-bit integer)
``u32[documents]``    ids of each document
``u64[blocks + 1]``   index: where each block starts behind this index
blocks                see below
====================  =======================================================

A block of (at most) ``BLOCK`` ids: ``u32`` minimum, ``u16`` exceptions,
``u8`` width, ``u8`` zero; then each id less the minimum packed at the block's
width; then the exceptions, as ``u16`` positions and ``u32`` high parts. The width
is the smallest that holds the given percentile of the block's ids, raised where
wider packing is smaller than its exceptions.

Writing: documents are encoded in place, dealt to files by ranges of ``doc_id``
(bounds from a quantile sketch of the ids alone), sorted inside a task and
written as rows (file, segment, image) in the shared folder. Segments are closed
at ``SEGMENT_IDS`` ids, so a task holds one segment at a time. Ids before a file
are running sums over one number per file.

Defined results: a null text holds the end id alone; null ids come first and stay
null; rows of equal ``doc_id`` follow each other in an order given by their texts;
an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.common import scratch_path, ship, total_text_bytes
from potable.llm.encoding import NULL_ID, encoded, id_width, ids_of
from potable.llm.workers import over_batches

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIIQ")
BLOCK_HEAD = struct.Struct("<IHBB")
BLOCK = 1024
PERCENTILE = 90
SEGMENT_IDS = 1 << 19
#: text bytes that make one file
FILE_BYTES = 24 << 20


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bits of each value, in order, lowest bit first."""
    if not width:
        return b""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=values.dtype)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, dtype=np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), dtype=np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


def packed_bytes(n: int, width: int) -> int:
    return -(-n * width // 8)


def pack_grid(grid: np.ndarray) -> list[bytes]:
    """Blocks of equal length, one a row."""
    count, n = grid.shape
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    need = np.frexp(rest.astype(np.float64))[1]  # bits of each value
    held = np.bincount((need + 33 * np.arange(count)[:, None]).ravel(), minlength=33 * count).reshape(count, 33).cumsum(axis=1)
    cost = -(-n * np.arange(33) // 8) + 6 * (n - held)
    cost[held < n * PERCENTILE / 100] = np.iinfo(np.int64).max
    widths = cost.argmin(axis=1)
    out = []
    for x, bits, lo, width in zip(rest, need, low.tolist(), widths.tolist(), strict=True):
        over = np.flatnonzero(bits > width)
        body = [pack_bits(x, width)]
        if over.size:
            body[0] = pack_bits(x & np.uint32((1 << width) - 1), width)
            body.append(over.astype("<u2").tobytes())
            body.append((x[over].astype(np.uint64) >> np.uint64(width)).astype("<u4").tobytes())
        out.append(b"".join([BLOCK_HEAD.pack(lo, over.size, width, 0), *body]))
    return out


def pack_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Blocks of an id sequence, and where each starts."""
    ids = ids.astype(np.uint32)
    full = len(ids) // BLOCK
    blocks = pack_grid(ids[: full * BLOCK].reshape(full, BLOCK)) if full else []
    if len(ids) % BLOCK:
        blocks += pack_grid(ids[full * BLOCK :].reshape(1, -1))
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return blocks, starts


def unpack_block(data: bytes, n: int) -> np.ndarray:
    low, over, width, _ = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size + packed_bytes(n, width)
    x = unpack_bits(data[BLOCK_HEAD.size : at], width, n).astype(np.uint64)
    if over:
        where = np.frombuffer(data, dtype="<u2", count=over, offset=at)
        high = np.frombuffer(data, dtype="<u4", count=over, offset=at + 2 * over)
        x[where] |= high.astype(np.uint64) << np.uint64(width)
    return (x + np.uint64(low)).astype(np.uint32)


def write_segment(doc_ids: list[int | None], docs: list[np.ndarray], before: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    blocks, starts = pack_blocks(ids)
    return b"".join([
        HEAD.pack(MAGIC, len(docs), len(blocks), BLOCK, before),
        np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([len(d) for d in docs], dtype="<u4").tobytes(),
        starts.tobytes(), *blocks,
    ])


class Segment:
    """Reader of one segment image; the block index gives any id range without the rest."""

    def __init__(self, image: bytes) -> None:
        magic, n, blocks, self.block, self.before = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at = HEAD.size
        self.doc_ids = np.frombuffer(image, dtype="<i8", count=n, offset=at)
        self.lengths = np.frombuffer(image, dtype="<u4", count=n, offset=at + 8 * n).astype(np.int64)
        at += 12 * n
        self.starts = np.frombuffer(image, dtype="<u8", count=blocks + 1, offset=at)
        self.body, self.image = at + 8 * (blocks + 1), image
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        k0, k1 = start // self.block, (stop - 1) // self.block
        total = int(self.first[-1])
        parts = [
            unpack_block(
                self.image[self.body + int(self.starts[k]) : self.body + int(self.starts[k + 1])],
                min(self.block, total - k * self.block),
            )
            for k in range(k0, k1 + 1)
        ]
        return np.concatenate(parts)[start - k0 * self.block : stop - k0 * self.block]


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the files below ``path``: rows (file, segment, n_ids, image)."""
    width = id_width(tokenizer_path)
    files = max(1, -(-total_text_bytes(docs, text_col) // FILE_BYTES))
    quantiles = [(i + 1) / files for i in range(files - 1)]
    bounds: list[int] = []
    if quantiles:
        row = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), quantiles, 100 * files).alias("q")).first()
        bounds = sorted(set(row["q"] or []))

    @over_batches
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, before, held = None, 0, 0, 0
        names: list[int | None] = []
        rows: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            image = write_segment(names, rows, before)
            return pa.RecordBatch.from_pydict(
                {"file": [file], "segment": [number], "n_ids": [held], "image": [image]}, schema=SEGMENT_SCHEMA
            )

        for batch in batches:
            for f, d, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if rows and (f != file or held >= SEGMENT_IDS):
                    yield close()
                    number, before, held, names, rows = number + 1, before + held, 0, [], []
                if f != file:
                    file, number, before = f, 0, 0
                names.append(d)
                rows.append(ids_of(blob, width))
                held += len(rows[-1])
        if rows:
            yield close()

    (
        encoded(docs, tokenizer_path, end_id, id_col, text_col, bounds)
        .repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "tie")
        .mapInArrow(pack, "file int, segment int, n_ids long, image binary")
        .write.mode("overwrite").option("compression", "none").parquet(path)
    )
    return path


SEGMENT_SCHEMA = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("image", pa.binary())])


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    ship(spark)
    segments = spark.read.parquet(path)
    # one number per file (a file holds at least tens of MB of text)
    sums = {r["file"]: r["n"] for r in segments.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for f in sorted(sums):
        before[f], total = total, total + sums[f]

    @over_batches
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(image.as_py())
                ids = s.ids(0, int(s.first[-1])).astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if d == NULL_ID else d for d in s.doc_ids.tolist()], pa.int64()),
                    "start": pa.array(s.first[:-1] + (before[f] + s.before), pa.int64()),
                    "n_tokens": pa.array(s.lengths),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(s.first[:-1], s.first[1:], strict=True)], pa.int64()),
                })

    return segments.select("file", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, **columns: str) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = write_token_files(docs, tokenizer_path, end_id, scratch_path(spark, "token-files"), **columns)
    return read_token_files(spark, path)
