"""Vector bin packing of examples into training sequences.

An example has three sizes: tokens, segments (1) and loss-bearing tokens. A
sequence has a limit for each. Examples are dealt to groups of about
``GROUP_BYTES`` of text by a hash of their content, and every group is packed by
itself, so a task holds one group and the number of groups follows the input.

Inside a group:

1. an example as long as a sequence or longer gives whole sequences of its own;
   what is left of it is packed with the others;
2. a sequence is filled by the dot-product heuristic: of the pieces that fit in
   all three limits, the one with the largest weighted dot product of its sizes
   and the sequence's remaining room goes in, until none fits. Pieces of equal
   sizes are one kind, so a step compares kinds and not pieces;
3. room that is left is filled by cutting the front off the largest piece (tokens
   may be cut anywhere; the rest of it stays to be packed);
4. a sequence that a limit closes early, and the last tokens of a group, are cut
   down to powers of two, which need no padding.

Defined results: a null text is the end id alone; rows of one ``doc_id`` are
packed as documents of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.common import total_text_bytes
from potable.llm.encoding import encoded, id_width, ids_of
from potable.llm.workers import over_pair

GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


Piece = tuple[int, int, int, int]  # example, start, length, loss-bearing tokens


class Bins:
    """Pieces by kind (length, loss), and the sequences made so far."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.number: dict[tuple[int, int], int] = {}
        self.pieces: list[deque[Piece]] = []
        self.length = np.zeros(64)
        self.loss = np.zeros(64)
        self.left = np.zeros(64, dtype=np.int64)
        self.sequences: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        kind = piece[2:]
        k = self.number.get(kind)
        if k is None:
            k = self.number[kind] = len(self.pieces)
            self.pieces.append(deque())
            if k == len(self.left):
                self.length, self.loss, self.left = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.loss, self.left))
            self.length[k], self.loss[k] = kind
        self.pieces[k].append(piece)
        self.left[k] += 1

    def take(self, k: int) -> Piece:
        self.left[k] -= 1
        return self.pieces[k].popleft()

    def fill(self) -> tuple[list[Piece], int, int]:
        """One sequence by the dot-product heuristic, and the room left in tokens and loss-bearing tokens."""
        limits = self.limits
        tokens, loss, out = limits.tokens, limits.loss_tokens, []
        while len(out) < limits.segments:
            fits = np.flatnonzero((self.left > 0) & (self.length <= tokens) & (self.loss <= loss))
            if not fits.size:
                break
            # the segment term is the same for every piece
            score = self.length[fits] * (tokens / limits.tokens**2) + self.loss[fits] * (loss / limits.loss_tokens**2)
            piece = self.take(int(fits[score.argmax()]))
            out.append(piece)
            tokens -= piece[2]
            loss -= piece[3]
        return out, tokens, loss

    def donor(self, tokens: int, loss: int) -> int | None:
        """The largest piece whose first ``tokens`` tokens go into the room that is left."""
        head_loss = np.maximum(0, tokens - (self.length - self.loss))
        able = np.flatnonzero((self.left > 0) & (self.length > tokens) & (head_loss <= loss))
        return int(able[self.length[able].argmax()]) if able.size else None

    def cut(self, piece: Piece, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` tokens and the rest; loss-bearing tokens are a piece's last ones."""
        example, start, length, loss = piece
        free = length - loss
        head_loss = max(0, n - free)
        return (example, start, n, head_loss), (example, start + n, length - n, loss - head_loss)

    def pack(self) -> list[list[Piece]]:
        while self.left.any():
            row, tokens, loss = self.fill()
            if tokens and len(row) < self.limits.segments and (k := self.donor(tokens, loss)) is not None:
                head, rest = self.cut(self.take(k), tokens)
                row.append(head)
                self.add(rest)
                tokens = 0
            self.sequences.append(self.to_power(row, self.limits.tokens - tokens) if tokens else row)
        return self.sequences

    def to_power(self, row: list[Piece], used: int) -> list[Piece]:
        """Cut a short sequence down to the largest power of two; the rest is packed again."""
        over = used - (1 << (used.bit_length() - 1))
        while over:
            piece = row.pop()
            if piece[2] <= over:
                self.add(piece)
                over -= piece[2]
            else:
                head, rest = self.cut(piece, piece[2] - over)
                row.append(head)
                self.add(rest)
                over = 0
        return row


def pack_examples(lengths: list[int], losses: list[int], limits: Limits) -> list[list[Piece]]:
    """Sequences of pieces; every token of every example lies in exactly one piece."""
    bins = Bins(limits)
    whole = min(limits.tokens, limits.loss_tokens)
    for i, (n, loss) in enumerate(zip(lengths, losses, strict=True)):
        piece = (i, 0, n, loss)
        while piece[2] >= limits.tokens or piece[3] > limits.loss_tokens:
            head, piece = bins.cut(piece, whole if piece[3] > limits.loss_tokens else limits.tokens)
            bins.sequences.append([head]) if head[2] == limits.tokens else bins.add(head)
        if piece[2]:
            bins.add(piece)
    return bins.pack()


PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents. Every token but a document's first (which nothing precedes) bears loss."""
    width = id_width(tokenizer_path)
    groups = max(1, -(-total_text_bytes(docs, text_col) // GROUP_BYTES))
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.col("tie"), F.octet_length("ids")), F.lit(groups)).cast("int")

    @over_pair
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        names = table.column("doc_id").to_pylist()
        blobs = [ids_of(b, width) for b in table.column("ids").to_pylist()]
        lengths = [len(b) for b in blobs]
        rows: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")}
        for number, sequence in enumerate(pack_examples(lengths, [n - 1 for n in lengths], limits)):
            offset = 0
            for i, start, n, loss in sequence:
                values = (
                    names[i], start, n, zlib.crc32(blobs[i][start : start + n].astype("<u4")), lengths[i],
                    (group << 32) + number, offset, loss,
                )
                for column, v in zip(rows.values(), values, strict=True):
                    column.append(v)
                offset += n
        return pa.table({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    return (
        encoded(docs, tokenizer_path, end_id, id_col, text_col)
        .withColumn("group", spread).groupBy("group").applyInArrow(pack, PIECE_SCHEMA)
    )
