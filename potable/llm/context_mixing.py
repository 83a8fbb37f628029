"""Language-model scores by logistic mixing of hashed-context bit predictors.

*Stream.* A text's words (A-Z lower-cased) joined by single blanks, then an end
mark. Each byte is a path of binary choices in one Huffman tree over all 256 byte
values, so the probabilities of all texts sum to one.

*Predictors.* Five contexts predict a choice: the last 2 to 5 bytes, and the word so
far. Context and tree node are hashed to one of the slots of that context's table,
which holds how often each side was taken. The tables' size is fixed (``BITS``, 67 MB),
whatever the input.

*Mixing.* Each predictor's log odds are weighted; the weights are gated by the
longest byte context that was seen before and by how often the word so far was, and
by how much the predictor has seen. Weights are learned online: each task goes through its
share of the events in small batches, from the last round's weights, and the rounds'
results are averaged. While learning, an event's own occurrence is taken out of the
counts, so the mixer sees what it would see on new text. A last adaptive table maps
(node, log odds) to observed frequencies and is averaged in.

*On Spark.* Equal events (word so far, five bytes, next byte) of all training texts
are counted inside tasks, then by one shuffle of packed arrays; tables, weights and the last table are
made from those counted events. For scoring, texts are dealt to blocks by a hash;
a worker evaluates
an event once and looks it up from then on, for as many events as it has places for (``Known``);
others are evaluated once a slice of texts. The unigram base needs each
word's count: distinct words of a block (64-bit hashes) are joined with the counts
and come back to their block.

Defined results: a null or empty text is its end alone; a document with a null id is
learned from and not held out; repeated rows count as often as they occur; an empty
table gives an empty result; with no training text the model is uniform over bytes;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.common import ship, total_text_bytes, written
from potable.llm.kneser_ney import stream
from potable.llm.shingles import row_slices, words_of
from potable.llm.workers import over_batches, over_group, over_pair

ORDERS = (2, 3, 4, 5)
CONTEXTS = len(ORDERS) + 1
WIDTH = max(ORDERS) + 1
#: slots of each context's table, as a power of two (the word so far has the most contexts)
BITS = (22, 22, 22, 22, 24)
FIRST = [sum(1 << b for b in BITS[:j]) for j in range(CONTEXTS)]
SLOTS = sum(1 << b for b in BITS)
#: slots of one piece of a table on its way to the driver
PIECE = 1 << 16
SLICE_BYTES = 2 << 20
#: text bytes whose events are made at once, so that their arrays stay in a core's cache
EVENT_BYTES = 1 << 18
BLOCK_BYTES = 16 << 20
#: text bytes for each bucket of counted events
BUCKET_BYTES = 4 << 20
#: entries a counting task holds before it merges them or passes them on
MOST_HELD = 1_500_000
#: entries of one batch on its way out of a counting task
MOST_SENT = 250_000
#: events that are learned in one random order
MOST_SHUFFLED = 500_000
ROUNDS = 2
BATCH = 1 << 13
#: places for the values of evaluated events in a scoring process (16 bytes each)
ROW_BITS, WAYS = 19, 4
STEP = 0.2
#: counts up to this are kept exactly, larger ones on a logarithmic scale (one byte each)
EXACT = 40
KINDS = 16  # 8 classes by total count, one-sided or not
#: gate: the longest of the byte contexts that was seen (0 to 5), by how the word so far was seen
GATES = (len(ORDERS) + 1) * KINDS
CELLS = 33
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_PRIME = 0x100000001B3


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the 64-bit keys in ascending order, and where each run of equal keys begins.

    Places are sorted within the low bits of their keys, by one sort of plain numbers; where
    keys differ only in those bits and come out of order, the whole keys are sorted.
    """
    low = np.uint64((1 << len(key).bit_length()) - 1)
    order = key & ~low
    order |= np.arange(len(key), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    found = key[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(key, kind="stable")
        found = key[order]
    return order, np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(key)])


class Powers:
    """Powers of an odd number and of its inverse, for hashes of word beginnings."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_PRIME, -1, 1 << 64)
            for name, base in (("up", _PRIME), ("down", inverse)):
                steps = np.full(n, np.uint64(base), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def events(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word-so-far hash, last bytes and next byte, first event of each text and the end)."""
    data, edges = stream(texts, WIDTH)
    first = edges - np.arange(len(edges)) * (WIDTH - 1)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), first
    two = data[:-1].astype(np.uint16) << np.uint16(8)
    two |= data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16)
    four |= two[2:]
    code = four[:-2].astype(np.int64) << 16  # of the six bytes up to each place
    code |= two[4:]
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)  # sums[i]: bytes before i
    np.add(data, np.uint64(1), out=sums[1:])
    sums[1:] *= up[:n]
    np.cumsum(sums[1:], out=sums[1:])
    # a word begins behind each separator; a stream begins with marks, so the first is at 0
    gaps = np.flatnonzero((data == 32) | (data == 10))
    size = np.diff(gaps, append=n - 1)
    row = np.repeat(np.arange(len(gaps)), size)[WIDTH - 2 :]
    word = sums[WIDTH - 1 : n] - sums[gaps + 1].take(row, mode="clip")
    word *= down[gaps + 1].take(row, mode="clip")
    # windows that begin in the last bytes of a stream reach into the next one
    inside = np.ones(len(code), dtype=bool)
    for back in range(1, WIDTH):
        inside[edges[1:-1] - back] = False
    return word[inside], code[inside], first


def event_keys(word: np.ndarray, code: np.ndarray) -> np.ndarray:
    key = mixed(code.view(np.uint64) * _A)
    key ^= word
    return mixed(key)


def coded_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each distinct word, word codes)."""
    coded = words.dictionary_encode()
    return hashed(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)


def hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)


# --- counting -----------------------------------------------------------------


def count_events(docs: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of each event of a text column, as rows of packed arrays (bucket, word, code, n).

    A bucket holds the events of a share of the contexts (by a hash of their last
    three bytes); tasks sum their own events, and each bucket's sums are merged while
    they stream by, at most ``MOST_HELD`` entries at a time.
    """

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for _, part in row_slices(batch.column(0), EVENT_BYTES):
                word, code, _ = events(part)
                if held.add(merged(event_keys(word, code), word, code)):
                    yield from bucket_rows(held.take(), buckets)
        if held.parts:
            yield from bucket_rows(held.take(), buckets)

    @over_batches
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, Held()
        for batch in batches:
            for b, (word, code, n) in zip(batch.column("bucket").to_pylist(), packed_events(batch), strict=True):
                if b != bucket and held.parts:
                    yield packed_rows([bucket], [held.take()])
                bucket = b
                if held.add((event_keys(word, code), word, code, n)):
                    yield packed_rows([bucket], [held.take()])
        if held.parts:
            yield packed_rows([bucket], [held.take()])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(run, PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, PACKED)


PACKED = "bucket int, word binary, code binary, n binary"


class Held:
    """Sums of equal events so far; ``add`` tells when they should be passed on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, part: tuple[np.ndarray, ...]) -> bool:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size <= MOST_HELD:
            return False
        self.parts = [self.merge()]
        self.size = len(self.parts[0][0])
        return self.size > MOST_HELD * 3 // 4

    def merge(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) == 1:
            return self.parts[0]
        *columns, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        return merged(*columns, n=n)

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.merge()
        self.parts, self.size = [], 0
        return out


def merged(key: np.ndarray, *columns: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys with their columns and the sums of ``n`` (else their occurrences)."""
    order, starts = runs(key)
    first = order[starts]
    total = np.diff(starts, append=len(key)) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n
    return key[first], *(c[first] for c in columns), total


def packed_rows(buckets: list[int], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    arrays = [pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *arrays], ["bucket", "word", "code", "n"])


def bucket_rows(part: tuple[np.ndarray, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Events by bucket, in batches of about ``MOST_SENT``."""
    bucket = mixed(((part[2].view(np.uint64) >> np.uint64(8)) & np.uint64(0xFFFFFF)) * _A) % np.uint64(buckets)
    order, starts = runs(bucket << np.uint64(32))
    found, ends = bucket[order[starts]], np.append(starts[1:], len(order))
    step = max(1, len(starts) * MOST_SENT // max(1, len(order)))
    for i in range(0, len(starts), step):
        few = zip(starts[i : i + step], ends[i : i + step], strict=True)
        yield packed_rows(found[i : i + step].tolist(), [(None, *(x[order[a:b]] for x in part[1:])) for a, b in few])


def packed_events(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for word, code, n in zip(*(batch.column(c).to_pylist() for c in ("word", "code", "n")), strict=True):
        yield np.frombuffer(word, np.uint64), np.frombuffer(code, np.int64), np.frombuffer(n, np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): occurrences of each word by its 64-bit hash, summed in the task first."""

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def rows() -> pa.RecordBatch:
            h, n = held.take()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

        for batch in batches:
            for _, part in row_slices(batch.column(0), 2 * SLICE_BYTES):
                words, _ = words_of(part)
                hashes, codes = coded_words(words)
                if held.add((hashes, np.bincount(codes, minlength=len(hashes)))):
                    yield rows()
        if held.parts:
            yield rows()

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# --- the model ----------------------------------------------------------------


@dataclass
class Tree:
    """Huffman paths of all byte values, laid end to end."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def __post_init__(self) -> None:
        self.hash = self.node.astype(np.uint64) * _A * _B
        self.sign = np.where(self.bit, -1.0, 1.0)

    @classmethod
    def of(cls, counts: np.ndarray) -> "Tree":
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children.append((a[2], b[2]))
            heapq.heappush(heap, (a[0] + b[0], 256 + len(children), 255 + len(children)))
        paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
        for i in range(len(children) - 1, -1, -1):
            own = paths.pop(256 + i)
            for bit, child in enumerate(children[i]):
                paths[child] = [*own, (i, bit)]
        length = np.array([len(paths[s]) for s in range(256)])
        flat = [step for s in range(256) for step in paths[s]]
        return cls(np.cumsum(length) - length, length, np.array([x[0] for x in flat]), np.array([x[1] for x in flat], dtype=np.uint8))

    def choices(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First choice of each event, and (event, place in the paths) of all choices, event by event."""
        byte = code & 255
        n = self.length[byte]
        row = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        return first, row, np.arange(len(row)) + (self.start[byte] - first).take(row, mode="clip")


def context_hashes(word: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    past = code.astype(np.uint64) >> np.uint64(8)
    out = [mixed(((past & np.uint64((1 << (8 * k)) - 1)) + np.uint64(k)) * _A) for k in ORDERS]
    return [*out, mixed(word * _A + np.uint64(77))]


def slots(j: int, context: np.ndarray, row: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Slot in the table of context ``j`` of each choice, from its event's row and the hash of its node."""
    at = (context * _B).take(row, mode="clip")
    at += nodes
    at >>= np.uint64(64 - BITS[j])
    return at.view(np.int64)


def stored(n: np.ndarray) -> np.ndarray:
    """A count as one byte."""
    wide = EXACT + np.round(8 * np.log2(np.maximum(n, EXACT) / EXACT))
    return np.where(n <= EXACT, n, np.minimum(wide, 255)).astype(np.uint8)


def restored() -> np.ndarray:
    x = np.arange(256, dtype=np.float64)
    return np.where(x <= EXACT, x, EXACT * 2 ** ((x - EXACT) / 8))


def state_tables() -> tuple[np.ndarray, np.ndarray]:
    """Log odds and kind of every pair of stored counts (first side in the low byte)."""
    c = restored()
    zero, one = np.meshgrid(c, c, indexing="xy")  # [one, zero]
    odds = np.log((one + 0.3) / (zero + 0.3)).astype(np.float32).ravel()
    size = np.searchsorted([0.5, 1.5, 2.5, 4.5, 8.5, 20.5, 100.5], zero + one)
    sided = (np.minimum(zero, one) == 0) & (zero + one > 0)
    return odds, (size * 2 + sided).astype(np.uint8).ravel()


@dataclass
class Model:
    tree: Tree
    tables: list[np.ndarray]  # per context: two stored counts in 16 bits
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, CONTEXTS, KINDS), 0.25, dtype=np.float64))
    refined: np.ndarray | None = None  # log odds by node and cell

    def __post_init__(self) -> None:
        self.odds, self.kinds = state_tables()
        if self.refined is not None:
            self.rise = np.diff(self.refined, append=0)  # to the cell above

    def inputs(self, hashes: list[np.ndarray], row: np.ndarray, place: np.ndarray, bit: np.ndarray, learning: bool) -> tuple[list, list]:
        """Per context: log odds, and the index of the weight that the gate selects."""
        odds, kinds = [], []
        nodes = self.tree.hash.take(place, mode="clip")
        if learning:
            shift = bit.astype(np.uint16) << np.uint16(3)
        gate = np.zeros(len(place), dtype=np.uint8)
        for j in range(CONTEXTS):
            state = self.tables[j].take(slots(j, hashes[j], row, nodes), mode="clip")
            if learning:  # without the event itself
                own = (state >> shift) & np.uint16(255)
                state -= ((own > 0) & (own <= EXACT)).astype(np.uint16) << shift
            state = state.astype(np.int64)
            odds.append(self.odds.take(state, mode="clip"))
            kinds.append(self.kinds.take(state, mode="clip"))
            if j < len(ORDERS):
                np.maximum(gate, (kinds[j] > 0).view(np.uint8) * np.uint8(j + 1), out=gate)
        gate *= np.uint8(KINDS)
        gate += kinds[-1]
        first = gate * np.uint16(CONTEXTS * KINDS)
        return odds, [(first + (kinds[j] + np.uint8(j * KINDS))).astype(np.int64) for j in range(CONTEXTS)]

    def mix(self, odds: list, index: list) -> np.ndarray:
        flat = self.weights.ravel()
        total = flat.take(index[0], mode="clip") * odds[0]
        for i, x in zip(index[1:], odds[1:], strict=True):
            term = flat.take(i, mode="clip")
            term *= x
            total += term
        return np.clip(total, -15.9, 15.9, out=total)

    def cells(self, node: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell below (node and log odds) and the share of the cell above."""
        x = np.clip(logit * 2 + (CELLS - 1) / 2, 0, CELLS - 1.001)
        low = x.astype(np.int64)
        return node * CELLS + low, x - low

    def refine(self, node: np.ndarray, logit: np.ndarray) -> np.ndarray:
        if self.refined is None:
            return logit
        at, share = self.cells(node, logit)
        share *= self.rise.take(at, mode="clip")
        share += self.refined.take(at, mode="clip")
        share += logit
        share *= 0.5
        return share

    def learn(self, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One online pass over counted events; returns how much each weight was exercised."""
        hashes = context_hashes(word, code)
        seen = np.zeros(self.weights.size)
        for a in range(0, len(code), BATCH):
            part = slice(a, a + BATCH)
            _, row, place = self.tree.choices(code[part])
            bit = self.tree.bit.take(place, mode="clip")
            times = n[part].astype(np.float64)[row]
            odds, index = self.inputs([h[part] for h in hashes], row, place, bit, learning=True)
            p = 1 / (1 + np.exp(-self.mix(odds, index)))
            miss, curve = (bit - p) * times, p * (1 - p) * times
            flat = self.weights.ravel()
            for i, x in zip(index, odds, strict=True):
                up = np.bincount(i, weights=miss * x, minlength=flat.size)
                bend = np.bincount(i, weights=curve * x * x, minlength=flat.size)
                flat += STEP * up / (bend + 1.0)
                seen += bend
            np.clip(flat, -2, 4, out=flat)
        return seen

    def tally(self, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Times and ones per cell of the last table, [2, nodes * cells]."""
        out = np.zeros((2, 256 * CELLS))
        hashes = context_hashes(word, code)
        for a in range(0, len(code), BATCH):
            part = slice(a, a + BATCH)
            _, row, place = self.tree.choices(code[part])
            bit = self.tree.bit.take(place, mode="clip")
            times = n[part].astype(np.float64)[row]
            logit = self.mix(*self.inputs([h[part] for h in hashes], row, place, bit, learning=True))
            at, share = self.cells(self.tree.node[place], logit)
            for cell, w in ((at, times * (1 - share)), (at + 1, times * share)):
                out[0] += np.bincount(cell, weights=w, minlength=out.shape[1])
                out[1] += np.bincount(cell, weights=w * bit, minlength=out.shape[1])
        return out

    def log2(self, word: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log2 probability of each event's byte."""
        out = np.zeros(len(code))
        hashes = context_hashes(word, code)
        for a in range(0, len(code), BATCH):
            part = slice(a, a + BATCH)
            first, row, place = self.tree.choices(code[part])
            bit = self.tree.bit.take(place, mode="clip")
            logit = self.mix(*self.inputs([h[part] for h in hashes], row, place, bit, learning=False))
            logit = self.refine(self.tree.node[place], logit)
            logit *= self.tree.sign.take(place, mode="clip")
            cost = np.log1p(np.exp(logit))
            out[part] = -np.add.reduceat(cost, first)
        return out / math.log(2)

    def text_log2(self, texts: pa.Array, known: "Known") -> tuple[np.ndarray, np.ndarray]:
        """(log2 probability, predicted bytes) of each text; equal events are evaluated once."""
        word, code, first = events(texts)
        key = event_keys(word, code)
        order, starts = runs(key)
        at = order[starts]
        value = known.values(key[at], lambda new: self.log2(word[at[new]], code[at[new]]))
        each = np.empty(len(code) + 1)
        each[0] = 0
        each[1:][order] = np.repeat(value, np.diff(starts, append=len(order)))
        np.cumsum(each, out=each)
        return each[first[1:]] - each[first[:-1]], np.diff(first)


class Known:
    """Values of keys seen before: a row of ``WAYS`` places for each beginning of a key, which takes no more once full."""

    def __init__(self) -> None:
        # a free place holds a key of another row
        self.free = (np.arange(1 << ROW_BITS, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - ROW_BITS)
        self.keys = np.repeat(self.free, WAYS).reshape(-1, WAYS)
        self.found = np.zeros((1 << ROW_BITS) * WAYS)

    def values(self, keys: np.ndarray, evaluate: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Values of distinct ascending keys; those not held are evaluated, from their places."""
        row = (keys >> np.uint64(64 - ROW_BITS)).view(np.int64)
        same = np.flatnonzero(self.keys.take(row, axis=0, mode="clip") == keys[:, None])
        held = same // WAYS
        out = np.empty(len(keys))
        out[held] = self.found.take(row[held] * WAYS + same % WAYS, mode="clip")
        missing = np.ones(len(keys), dtype=bool)
        missing[held] = False
        left = np.flatnonzero(missing)
        out[left] = evaluate(left)
        for way in range(WAYS):
            at = row[left]
            put = self.keys[at, way] == self.free[at]
            put[1:] &= at[1:] != at[:-1]
            self.keys[at[put], way] = keys[left[put]]
            self.found[at[put] * WAYS + way] = out[left[put]]
            left = left[~put]
        return out


_TABLES: dict[str, list[np.ndarray]] = {}
_KNOWN: dict[str, Known] = {}


def table_arrays(key: str, pieces: dict[int, bytes]) -> list[np.ndarray]:
    """The tables of one model from compressed pieces; a worker process keeps the last model's."""
    if key not in _TABLES:
        _TABLES.clear()
        _KNOWN.clear()
        whole = np.zeros(SLOTS, dtype=np.uint16)
        for number, data in pieces.items():
            whole[number * PIECE : (number + 1) * PIECE] = np.frombuffer(zstandard.decompress(data), dtype=np.uint16)
        _TABLES[key] = np.split(whole, FIRST[1:])
    return _TABLES[key]


def fit_tables(counted: DataFrame, tree: Tree) -> dict[int, bytes]:
    """Slot counts of all contexts, summed in Spark; the driver receives the fixed-size tables in compressed pieces."""

    @over_batches
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in packed_events(batch):
                for a in range(0, len(whole[0]), MOST_SHUFFLED // 2):
                    yield from counts(*(x[a : a + MOST_SHUFFLED // 2] for x in whole))

    def counts(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, row, place = tree.choices(code)
        nodes, bit = tree.hash[place], tree.bit[place]
        times = n.astype(np.float64)[row]
        for j, h in enumerate(context_hashes(word, code)):
            slot = slots(j, h, row, nodes)
            order, starts = runs(slot.view(np.uint64) << np.uint64(32))
            both, ones = times[order], bit[order]
            ones = np.add.reduceat(both * ones, starts)
            both = np.add.reduceat(both, starts)
            yield slot_rows(slot[order[starts]] + FIRST[j], both - ones, ones)

    @over_batches
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, sums = -1, np.zeros((2, PIECE))

        def row() -> pa.RecordBatch:
            zeros, ones = (stored(x).astype(np.uint16) for x in sums)
            data = zstandard.compress((zeros | (ones << np.uint16(8))).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([data], pa.binary())], ["piece", "data"])

        for batch in batches:
            for number, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if number != piece and piece >= 0:
                    yield row()
                    sums[:] = 0
                piece = number
                part = np.frombuffer(data, dtype=SLOT)
                sums[0, part["at"]] += part["zeros"]
                sums[1, part["at"]] += part["ones"]
        if piece >= 0:
            yield row()

    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.mapInArrow(expand, "piece int, data binary").repartition(parts, "piece").sortWithinPartitions("piece")
    return {r["piece"]: bytes(r["data"]) for r in dealt.mapInArrow(total, "piece int, data binary").collect()}


#: a slot's counts on their way (more than a stored count can tell apart)
SLOT = np.dtype([("at", "<u2"), ("zeros", "<u4"), ("ones", "<u4")])


def slot_rows(slot: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> pa.RecordBatch:
    """Counts of ascending slots, a row for each piece of a table."""
    rows = np.empty(len(slot), dtype=SLOT)
    rows["at"] = slot % PIECE
    rows["zeros"], rows["ones"] = np.minimum(zeros, 4e9), np.minimum(ones, 4e9)
    piece, starts = np.unique(slot // PIECE, return_index=True)
    data = [rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(data, pa.binary())], ["piece", "data"])


@dataclass
class Trained:
    """A model on its way to the tasks: the tables as one broadcast, the rest by value."""

    key: str
    tree: Tree
    pieces: Broadcast
    weights: np.ndarray
    refined: np.ndarray

    def model(self) -> Model:
        return Model(self.tree, table_arrays(self.key, self.pieces.value), self.weights, self.refined)

    def known(self) -> Known:
        """What this worker process has evaluated with this model."""
        return _KNOWN.setdefault(self.key, Known())


def shuffled(parts: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
    """Events of many buckets in a seeded random order (a bucket's contexts are alike)."""
    held, size = [], 0

    def mixed_up() -> tuple[np.ndarray, ...]:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.random.default_rng(size).permutation(size)
        return tuple(x[order] for x in whole)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= MOST_SHUFFLED:
            yield mixed_up()
            held, size = [], 0
    if held:
        yield mixed_up()


def train(counted: DataFrame) -> Trained:
    """The model of counted events: tables, rounds of online learning, last table."""
    context = counted.sparkSession.sparkContext

    def shares(work) -> np.ndarray:
        """Sum over tasks of arrays of a fixed, small size."""

        @over_batches
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = work(part for batch in batches for part in packed_events(batch))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["k", "data"])

        @over_group
        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, dtype=np.float64) for b in table.column("data").to_pylist())
            return pa.table({"k": pa.array([0], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

        parts = counted.mapInArrow(run, "k int, data binary")
        # sums of sums: a task adds at most some dozens of arrays at either step
        some = parts.withColumn("k", (F.rand(1) * 64).cast("int")).groupBy("k").applyInArrow(add, "k int, data binary")
        found = [np.frombuffer(r["data"], dtype=np.float64) for r in some.collect()]
        return np.sum(found, axis=0) if found else np.zeros(0)

    def bytes_seen(parts: Iterator) -> np.ndarray:
        out = np.zeros(256)
        for _, code, n in parts:
            out += np.bincount(code & 255, weights=n, minlength=256)
        return out

    counts = shares(bytes_seen)
    tree = Tree.of(counts if len(counts) else np.zeros(256))
    key = uuid.uuid4().hex
    pieces = context.broadcast(fit_tables(counted, tree))
    weights = Model(tree, []).weights
    for _ in range(ROUNDS):
        now = weights

        def learn(parts: Iterator, now: np.ndarray = now) -> np.ndarray:
            local = Model(tree, table_arrays(key, pieces.value), now.copy())
            seen = np.zeros(now.size)
            for word, code, n in shuffled(parts):
                seen += local.learn(word, code, n)
            return np.concatenate([(local.weights.ravel() * seen), seen])

        found = shares(learn)
        moved, seen = np.split(found if len(found) else np.zeros(2 * now.size), 2)
        weights = np.where(seen > 0, moved / np.maximum(seen, 1e-9), now.ravel()).reshape(now.shape)

    def tally(parts: Iterator) -> np.ndarray:
        local = Model(tree, table_arrays(key, pieces.value), weights)
        out = np.zeros((2, 256 * CELLS))
        for word, code, n in parts:
            out += local.tally(word, code, n)
        return out.ravel()

    found = shares(tally)
    times, ones = np.split(found if len(found) else np.zeros(2 * 256 * CELLS), 2)
    prior = 1 / (1 + np.exp(-(np.arange(CELLS) - (CELLS - 1) / 2) / 2))
    p = (ones + 30 * np.tile(prior, 256)) / (times + 30)
    return Trained(key, tree, pieces, weights, np.log(p / (1 - p)))


# --- scoring --------------------------------------------------------------------


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
    training = docs.where(~held_out).select(text.alias("text"))
    counts = written(count_words(training), "word-counts")
    ends = training.count()
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total = (row["n"] or 0) + ends
    vocabulary = row["v"] + (ends > 0)
    size = total_text_bytes(docs, text_col)
    counted = written(count_events(training, max(64, size // BUCKET_BYTES)), "events")
    trained = train(counted)

    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int").alias("block"),
        doc_id.alias("doc_id"), held_out.alias("held_out"), text.alias("text"),
    ).repartition(blocks, "block")

    @over_group
    def distinct(table: pa.Table) -> pa.Table:
        words = [pc.unique(words_of(part)[0]) for chunk in table.column("text").chunks for _, part in row_slices(chunk, SLICE_BYTES)]
        found = hashed(pc.unique(pa.concat_arrays(words)))
        block = np.full(len(found), table.column("block")[0].as_py(), dtype=np.int32)
        return pa.table({"block": block, "h": found.view(np.int64)})

    @over_pair
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own, seen = trained.model(), trained.known()
        at = np.argsort(right.column("h").to_numpy())
        known, times = right.column("h").to_numpy()[at], right.column("c").to_numpy()[at]
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for chunk in left.column("text").chunks:
            for _, part in row_slices(chunk, SLICE_BYTES):
                part = pa.concat_arrays([part])
                words, edges = words_of(part)
                hashes, codes = coded_words(words)
                hashes = hashes.view(np.int64)
                c = np.zeros(len(hashes), dtype=np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    c = np.where(known[place] == hashes, times[place], 0)
                lp = np.log10((c + 1) / (total + vocabulary + 1))
                end = math.log10((ends + 1) / (total + vocabulary + 1))

                def sums(values: np.ndarray, edges: np.ndarray = edges, codes: np.ndarray = codes) -> np.ndarray:
                    upto = np.concatenate([[0], np.cumsum(values[codes])])
                    return upto[edges[1:]] - upto[edges[:-1]]

                out["n_tokens"].append(np.diff(edges) + 1)
                out["n_known"].append(sums((c > 0).astype(np.int64)) + (ends > 0))
                out["base_score"].append(sums(lp) + end)
                for _, few in row_slices(part, EVENT_BYTES):
                    bits, size = own.text_log2(few, seen)
                    out["score"].append(bits * math.log10(2))
                    out["n_bytes"].append(size)
        whole = {c: np.concatenate(v) for c, v in out.items()}
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"),
            **{c: whole[c].astype(np.int64) for c in ("n_tokens", "n_known")},
            "train_tokens": np.full(left.num_rows, total, dtype=np.int64),
            "base_score": whole["base_score"], "score": whole["score"], "n_bytes": whole["n_bytes"].astype(np.int64),
        })

    # both branches read the same shuffled texts (the exchange is reused)
    back = rows.groupBy("block").applyInArrow(distinct, "block int, h long").join(counts, "h").select("block", "h", "c")
    scored = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long",
    )
    return scored.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
