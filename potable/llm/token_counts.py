"""Token counts by a compiled finite-state tokenizer.

Two deterministic machines are compiled from a tokenizer file of the word-level
BPE kind.

*Splitter*: eight states over character classes mark where pre-tokens begin. A
slice of texts is cut into chunks of equal length, anywhere. All chunks advance in
step, each from all eight states, which gives one state map per chunk; a prefix
scan (doubling) composes the maps, which gives each chunk its true entry state;
a second pass reads off the marks.

*Word transducer*: reads a pre-token's bytes and annotates each transition with
the number of tokens that are settled by it. A state is the longest suffix read
that can still begin a longer token, with the last token ending at each of its
positions. A token may follow another exactly if the merge rules leave the two
apart when they are applied to both together; exactly one token ending at a new
byte follows on, so the machine is deterministic. States are compiled when first
reached; the table is bounded and starts anew when full. Each distinct pre-token
of a slice is read once.

Defined results: a null text counts as empty (0 tokens, 0 bytes); a null id stays
null; repeated rows give repeated results; an empty table gives an empty result.
Only the id and text columns are read, so other columns never clash. Texts that
hold special strings, or code points whose normal form depends on neighbours, are
counted with the library itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.common import ship
from potable.llm.shingles import row_slices
from potable.llm.word_tokens import (
    DIGIT, LETTER, SPACE, WordTokens, binary_list, byte_letters, pretoken_array, text_slices,
)
from potable.llm.workers import over_batches

# splitter states
NONE, WORD, RUN, QUOTE, Q_R, Q_V, Q_L, DONE = range(8)
# symbol classes: space, letter, s/t/m/d, e, l, r, v, digit, other, apostrophe
C_SPACE, C_LETTER, C_STMD, C_E, C_L, C_R, C_V, C_DIGIT, C_OTHER, C_QUOTE = range(10)
CLASSES = 10
#: marks: a pre-token begins here / began one position before
HERE, BEFORE = 1, 2
CHUNK = 128


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) tables, flat over state * CLASSES + class."""
    letters = (C_LETTER, C_STMD, C_E, C_L, C_R, C_V)
    go = np.zeros((8, CLASSES), dtype=np.uint8)
    mark = np.zeros((8, CLASSES), dtype=np.uint8)

    def rule(state: int, classes, to: int, m: int) -> None:
        for c in classes:
            go[state, c], mark[state, c] = to, m

    for s in range(8):
        rule(s, (C_SPACE,), NONE, 0)
        rule(s, letters, WORD, HERE)
        rule(s, (C_DIGIT,), DONE, HERE)
        rule(s, (C_OTHER,), RUN, HERE)
        rule(s, (C_QUOTE,), QUOTE, HERE)
    rule(WORD, letters, WORD, 0)
    rule(RUN, (C_OTHER, C_QUOTE), RUN, 0)
    rule(QUOTE, (C_OTHER, C_QUOTE), RUN, 0)
    rule(QUOTE, (C_STMD,), DONE, 0)
    for c, s in ((C_R, Q_R), (C_V, Q_V), (C_L, Q_L)):
        rule(QUOTE, (c,), s, 0)
    for s, end in ((Q_R, C_E), (Q_V, C_E), (Q_L, C_L)):
        # not a contraction after all: the letter behind the quote began a word
        rule(s, letters, WORD, BEFORE)
        for c in (C_SPACE, C_DIGIT, C_OTHER, C_QUOTE):
            mark[s, c] |= BEFORE
        rule(s, (end,), DONE, 0)
    return go.ravel(), mark.ravel()


class SplitMachine:
    def __init__(self) -> None:
        self.go, self.mark = splitter()
        self.of_letter = np.zeros(128, dtype=np.uint8)
        for c, k in (("s", C_STMD), ("t", C_STMD), ("m", C_STMD), ("d", C_STMD), ("e", C_E), ("l", C_L), ("r", C_R), ("v", C_V)):
            self.of_letter[ord(c)] = k
        self.of_kind = np.full(8, C_OTHER, dtype=np.uint8)
        self.of_kind[[SPACE, LETTER, DIGIT]] = C_SPACE, C_LETTER, C_DIGIT

    def classes(self, low: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = self.of_kind[kind]
        plain = low < 128
        special = np.where(plain, self.of_letter[np.where(plain, low, 0)], 0)
        out = np.where((kind == LETTER) & (special > 0), special, out)
        out[(low == ord("'")) & (kind != SPACE)] = C_QUOTE
        return out

    def starts(self, classes: np.ndarray) -> np.ndarray:
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.zeros((CHUNK, chunks), dtype=np.uint8)  # step by chunk, so that a step is contiguous
        padded = np.zeros(chunks * CHUNK, dtype=np.uint8)
        padded[:n] = classes
        grid[:] = padded.reshape(chunks, CHUNK).T
        maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], chunks, axis=1)  # entry state by chunk
        for step in grid:
            maps = self.go.take(maps * CLASSES + step)
        entry = self.entries(maps)
        marks = np.empty((CHUNK, chunks), dtype=np.uint8)
        state = entry
        for j, step in enumerate(grid):
            at = state * np.uint8(CLASSES) + step
            marks[j] = self.mark.take(at)
            state = self.go.take(at)
        flat = marks.T.ravel()[:n]
        start = (flat & HERE) > 0
        start[:-1] |= (flat[1:] & BEFORE) > 0
        return start

    @staticmethod
    def entries(maps: np.ndarray) -> np.ndarray:
        """Entry state of each chunk: state maps composed by an inclusive scan with doubling, read at NONE."""
        scan = maps.copy()
        step = 1
        while step < scan.shape[1]:
            scan[:, step:] = np.take_along_axis(scan[:, step:], scan[:, :-step].astype(np.intp), axis=0)
            step *= 2
        return np.concatenate([[NONE], scan[NONE, :-1]]).astype(np.uint8)


class WordTransducer:
    """Symbols are bytes, with 256 added to a word's last byte."""

    STATES = 400_000
    PAIRS = 1_000_000

    def __init__(self, model: dict) -> None:
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        end = model["end_of_word_suffix"]

        def symbols(name: str) -> tuple[int, ...]:
            last = name.endswith(end)
            out = [byte_of[c] for c in (name[: -len(end)] if last else name)]
            if last:
                out[-1] += 256
            return tuple(out)

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {(b,) for b in range(512)} | {a + b for a, b in self.rank}
        self.open = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.pairs: dict = {}
        self.clear()

    def clear(self) -> None:
        start = ((), ((None, 0),))
        self.number = {start: 0}
        self.state = [start]
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.words: dict[bytes, int] = {}

    def merged(self, parts: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 30), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, last: tuple[int, ...] | None, token: tuple[int, ...]) -> bool:
        ok = self.pairs.get((last, token))
        if ok is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            ends = [token] if last is None else [last, token]
            ok = self.pairs[last, token] = self.merged([(b,) for t in ends for b in t]) == ends
        return ok

    def compile(self, number: int, symbol: int) -> tuple[int, int]:
        """The transition and the tokens that it settles."""
        suffix, ends = self.state[number]
        read = (*suffix, symbol)
        for p, (last, count) in enumerate(ends):
            if read[p:] in self.tokens and self.follows(last, read[p:]):
                new = (read[p:], count + 1)
                break
        ends = (*ends, new)
        drop = next((k for k in range(len(read)) if read[k:] in self.open), len(read))
        if symbol >= 256:  # the word ends, so all is settled
            return 0, new[1]
        settled = ends[drop][1]
        state = (read[drop:], tuple((t, n - settled) for t, n in ends[drop:]))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.state)
            self.state.append(state)
            self.next.append({})
        return to, settled

    def count(self, word: bytes) -> int:
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self.state) > self.STATES or len(self.words) > self.STATES:
            self.clear()
        at = total = 0
        for symbol in (*word[:-1], word[-1] + 256):
            arc = self.next[at].get(symbol)
            if arc is None:
                arc = self.next[at][symbol] = self.compile(at, symbol)
            at, n = arc
            total += n
        self.words[word] = total
        return total


class TokenCounter:
    def __init__(self, path: str) -> None:
        import json

        self.base = WordTokens(path)
        self.split = SplitMachine()
        self.words = WordTransducer(json.loads(self.base.tokenizer.to_str())["model"])

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        for parts, owner in text_slices(texts):
            np.add.at(out, owner, self.count_parts(parts))
        return out

    def count_parts(self, parts: list[str]) -> np.ndarray:
        special = {i for i, p in enumerate(parts) if self.base.special.search(p)}
        texts = ["" if i in special else p for i, p in enumerate(parts)]
        low, kind, bounds, odd = self.base.characters.read(texts)
        start = self.split.starts(self.split.classes(low, kind))
        pre = pretoken_array(low, kind, start).dictionary_encode()
        each = np.fromiter(map(self.words.count, binary_list(pre.dictionary)), dtype=np.int64, count=len(pre.dictionary))
        ends = np.concatenate([[0], np.cumsum(each[pre.indices.to_numpy(zero_copy_only=False)])])
        out = np.diff(ends[np.searchsorted(np.flatnonzero(start), bounds)])
        for i in special | odd:
            out[i] = len(self.base.whole(parts[i]))
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """One instance per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""

    @over_batches
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path)
        for batch in batches:
            n = [counter.count(part.to_pylist()) for _, part in row_slices(batch.column(1))]
            counted = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counted], [id_col, "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("__text"), F.octet_length(text).cast("long").alias("__bytes"))
    kind = dict(rows.dtypes)[id_col]
    out = rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
