"""Words of texts and hashes of word shingles, by Arrow and array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def row_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) with about ``limit`` bytes each; nulls become empty texts."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield a, texts.slice(a, b - a)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words (split at ASCII white space, A-Z lower-cased) and the first word of each text (and the end)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled, min_count=0).as_py():  # white space at an end leaves an empty string
        keep = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        words, edges = words.filter(filled), keep[edges]
    return words, edges


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(64-bit hash of each distinct word, word codes, distinct words)."""
    coded = words.dictionary_encode()
    offsets = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int32)[: len(coded.dictionary) + 1]
    data = coded.dictionary.buffers()[2]
    return hash_strings(data, offsets), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_strings(data: pa.Buffer | None, offsets: np.ndarray) -> np.ndarray:
    import xxhash

    view = memoryview(data) if data is not None else memoryview(b"")
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(
        (digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)),
        dtype=np.uint64, count=len(offsets) - 1,
    )


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each window of ``k`` values (one for each start with enough behind it)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text); fewer than ``k`` words make one shingle."""
    for at, part in row_slices(texts):
        words, edges = words_of(part)
        hashes, codes, _ = word_hashes(words)
        each = hashes[codes]
        windows = rolling(each, k)
        sets = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(windows[a : b - k + 1]))
            elif b > a:
                sets.append(rolling(each[a:b], b - a) ^ np.uint64(b - a))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
        yield at, sets
