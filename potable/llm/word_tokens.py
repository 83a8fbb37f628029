"""Pre-tokens and token ids of texts for word-level BPE files, by array operations.

Runs inside tasks. A slice of texts becomes one array of code points; tables
(filled by asking the tokenizer about each code point once) give its lower case
and its class, array comparisons give the pre-token starts, and every distinct
pre-token is tokenized once. Texts with special strings or with code points whose
normal form depends on their neighbours are given whole to the library.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, OTHER, ODD = 1, 2, 3, 4, 5
SLICE_BYTES = 2 << 20
_TOKENIZERS: dict[str, "WordTokens"] = {}


def word_tokens(path: str) -> "WordTokens":
    """One instance per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1, then 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


def text_slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in slices of about ``limit`` characters, with each part's text number.

    A longer text is cut behind white space, where every tokenizer state is the
    start state, so the parts' tokens are the text's tokens.
    """
    parts: list[str] = []
    owner: list[int] = []
    room = limit
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > limit:
                found = re.compile(r"[ \t\n\r]").search(text, at + limit)
                end = found.end() if found else end
            parts.append(text[at:end])
            owner.append(i)
            room -= end - at
            if room <= 0:
                yield parts, owner
                parts, owner, room = [], [], limit
            at = end
            if at >= len(text):
                break
    if parts:
        yield parts, owner


class Characters:
    """Lower case and class of code points as this tokenizer sees them."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.low = np.arange(0x110000, dtype=np.uint32)
        self.kind = np.zeros(0x110000, dtype=np.uint8)

    def learn(self, points: np.ndarray) -> None:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            low = c if p in (9, 10, 11, 12, 13, 32) else self.tokenizer.normalizer.normalize_str(c)
            category = unicodedata.category(c)
            jamo = 0x1100 <= p < 0x1200 or 0xA960 <= p < 0xA980 or 0xD7B0 <= p < 0xD800
            if len(low) != 1 or category[0] == "M" or category == "Cn" or jamo:
                self.kind[p] = ODD
            elif not split(low):
                self.kind[p] = SPACE
            elif len(split(f"a{low}a")) == 1:
                self.kind[p] = LETTER
            else:
                self.kind[p] = OTHER if len(split(f"!{low}!")) == 1 else DIGIT
            if self.kind[p] != ODD:
                self.low[p] = ord(low)

    def read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
        """Lower-cased code points and classes of all parts, a line end behind each; first
        position of each part (and the end); parts that hold odd code points (as spaces)."""
        points = np.frombuffer("\n".join([*parts, "\n\n\n"]).encode("utf-32-le"), dtype="<u4")
        bounds = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
        kind = self.kind[points]
        if not kind.all():
            self.learn(np.unique(points[kind == 0]))
            kind = self.kind[points]
        odd: set[int] = set()
        if (kind == ODD).any():
            odd = set(np.unique(np.searchsorted(bounds, np.flatnonzero(kind == ODD), side="right") - 1).tolist())
            for i in odd:
                kind[bounds[i] : bounds[i + 1]] = SPACE
        return self.low[points], kind, bounds, odd


def pretoken_array(low: np.ndarray, kind: np.ndarray, start: np.ndarray) -> pa.Array:
    """The pre-tokens' UTF-8 bytes as one Arrow array (no copy per pre-token)."""
    keep = kind != SPACE
    points = low[keep]
    first = np.flatnonzero(start[keep])
    if points.size and points.max() < 128:
        data = points.astype(np.uint8).tobytes()
        offsets = np.append(first, points.size)
    else:
        data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        width = np.ones(points.size, dtype=np.int64)
        for bound in (0x80, 0x800, 0x10000):
            width += points >= bound
        ends = np.concatenate([[0], np.cumsum(width)])
        offsets = ends[np.append(first, points.size)]
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(first), buffers)


def binary_list(array: pa.Array) -> list[bytes]:
    """The values of an array without nulls (slices of one buffer; much faster than ``to_pylist``)."""
    edges = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    data = array.buffers()[2].to_pybytes() if array.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class WordTokens:
    #: distinct pre-tokens whose ids are kept (about 200 bytes each)
    CACHE = 120_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.characters = Characters(self.tokenizer)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word_ids(self, word: bytes) -> bytes:
        """Ids of one pre-token as 32-bit integers."""
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= self.CACHE:
                self.known.clear()
            tokens = self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))
            ids = self.known[word] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def starts(self, low: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """True where a pre-token begins: at a class change, at each digit, around contractions."""
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
        quote = np.flatnonzero((low == ord("'")) & start)
        if quote.size:
            a, b = low[quote + 1], low[quote + 2]
            short = np.isin(a, [ord(c) for c in "stmd"])
            long = (np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for mask, n in ((short, 2), (long, 3)):
                at = quote[mask]
                start[at + 1] = False
                start[at + n] = kind[at + n] != SPACE
        return start

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each text, equal to the library's ``encode(..., add_special_tokens=False)``."""
        special = {i for i, p in enumerate(parts) if self.special.search(p)}
        low, kind, bounds, odd = self.characters.read(["" if i in special else p for i, p in enumerate(parts)])
        start = self.starts(low, kind)
        pre = pretoken_array(low, kind, start).dictionary_encode()
        words = [self.word_ids(w) for w in binary_list(pre.dictionary)]
        code = pre.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) // 4
        flat = np.frombuffer(b"".join(words), dtype="<u4")
        first = np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[code] - (ends - n), n) + np.arange(total)]
        of_part = np.searchsorted(np.flatnonzero(start), bounds)
        cut = np.concatenate([[0], ends])[of_part]
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(parts))]
        for i in special | odd:
            out[i] = np.array(self.whole(parts[i]), dtype=np.uint32)
        return out

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each whole text, in order."""
        held: list[np.ndarray] = []
        at = 0
        for parts, owner in text_slices(texts):
            for ids, i in zip(self.encode(parts), owner, strict=True):
                if i != at:
                    yield np.concatenate(held) if len(held) > 1 else held[0]
                    held, at = [], i
                held.append(ids)
        if held:
            yield np.concatenate(held) if len(held) > 1 else held[0]
