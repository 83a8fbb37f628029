"""How the filters of a pipeline overlap, for every order in which they could run.

1. Spark turns each document into a mask of the filters that it fails, and counts
   documents (all, good, toxic) per part and mask.
2. A part's masks become a decision diagram: a level per filter, a node with a pass
   and a fail edge, equal nodes shared, edges without documents left out. Every node
   knows how many documents run through it.
3. All orders are visited by swaps of two adjacent levels (each order is one swap away
   from the one before it); a swap rebuilds only the two levels it touches. In each
   order the path along the pass edges gives the steps: what leaves it by the fail
   edge of a level is removed there.

A part is one group of at most 2**filters counted masks, whatever the number of
documents. Documents with the text of a smaller id are found on a 256-bit hash; rows
are counted per (hash, part, id) first, so a text that a third of all rows share
reaches no task as rows.

Defined results: a null text is an empty one, a null part the empty string; rows of
one id and text are counted each, and are no copies of each other; a row without an id
is never a copy and makes none; an id that has several labels is good or toxic if any
of them says so, one without a label is neither; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.llm.common import WORD_PATTERN, ship, written

Counts = tuple[int, int, int]  # documents, good ones, toxic ones
EMPTY = -1


def _plus(a: Counts, b: Counts) -> Counts:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


class CountDiagram:
    """Counted failure masks as levels of shared (pass, fail) nodes."""

    def __init__(self, letters: str, masks: dict[int, Counts]) -> None:
        self.letters = list(letters)  # the filter of each level, first one on top
        self.total: dict[int, Counts] = {EMPTY: (0, 0, 0)}
        self.nodes: list[dict[int, tuple[int, int]]] = [{} for _ in letters]
        self.shared: list[dict[tuple[int, int], int]] = [{} for _ in letters]
        self._fresh = count()
        leaves: dict[Counts, int] = {}
        self.root = self._build(0, masks, leaves)

    def _node(self, level: int, passed: int, failed: int) -> int:
        """The node of this level with these edges (``EMPTY`` if no document takes either)."""
        if passed == failed == EMPTY:
            return EMPTY
        known = self.shared[level].get((passed, failed))
        if known is None:
            known = self.shared[level][passed, failed] = next(self._fresh)
            self.nodes[level][known] = (passed, failed)
            self.total[known] = _plus(self.total[passed], self.total[failed])
        return known

    def _build(self, level: int, masks: dict[int, Counts], leaves: dict[Counts, int]) -> int:
        if not masks:
            return EMPTY
        if level == len(self.letters):
            weight = next(iter(masks.values()))
            if weight not in leaves:
                leaves[weight] = next(self._fresh)
                self.total[leaves[weight]] = weight
            return leaves[weight]
        bit = 1 << level
        sides = [{m: w for m, w in masks.items() if bool(m & bit) == failed} for failed in (False, True)]
        return self._node(level, *(self._build(level + 1, side, leaves) for side in sides))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; nodes above keep their edges."""
        upper, lower = self.nodes[level], self.nodes[level + 1]
        self.nodes[level + 1], self.shared[level + 1] = {}, {}
        missing = (EMPTY, EMPTY)
        for node, edges in upper.items():
            (pp, pf), (fp, ff) = (lower.get(e, missing) for e in edges)
            upper[node] = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        self.shared[level] = {edges: node for node, edges in upper.items()}
        for gone in lower:
            del self.total[gone]
        self.letters[level], self.letters[level + 1] = self.letters[level + 1], self.letters[level]

    def all_pass_path(self) -> Iterator[tuple[str, Counts, Counts]]:
        """(filter, kept, removed) of each level along the pass edges."""
        node = self.root
        for level, letter in enumerate(self.letters):
            passed, failed = self.nodes[level].get(node, (EMPTY, EMPTY))
            yield letter, self.total[passed], self.total[failed]
            node = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions whose swap with the next visits all orders of ``n`` things, each once.

    The last thing runs through the others and back; when it stands at an end, the
    others take one step of their own order of visits.
    """
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1
        yield from range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_part(part: str, letters: str, masks: dict[int, Counts]) -> list[tuple]:
    """All orders and steps of one part, in the columns of ``AUDIT``."""
    diagram = CountDiagram(letters, masks)
    paths = [list(diagram.all_pass_path())]
    orders = ["".join(diagram.letters)]
    for level in adjacent_swaps(len(letters)):
        diagram.swap(level)
        paths.append(list(diagram.all_pass_path()))
        orders.append("".join(diagram.letters))
    fails, alone, shares = {}, {}, dict.fromkeys(letters, 0)
    for path in paths:
        fails[path[0][0]] = path[0][2][0]  # first of all: removes whatever it fails
        alone[path[-1][0]] = path[-1][2][0]  # last of all: removes what it alone fails
        for letter, _, removed in path:
            shares[letter] += removed[0]
    return [
        (part, order, step, kept[0], removed[0], fails[letter] - removed[0], alone[letter], removed[1], removed[2], shares[letter])
        for order, path in zip(orders, paths, strict=True)
        for step, (letter, kept, removed) in enumerate(path, 1)
    ]


def filter_audit(masks: DataFrame, letters: str) -> DataFrame:
    """Every order and step of the filters ``letters``, by part.

    ``masks`` has part, mask (bit i set: filter i failed), n, good and toxic, at most
    one row per part and mask.
    """
    ship(masks.sparkSession)

    def audit(rows: pd.DataFrame) -> pd.DataFrame:
        counted = {
            int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)
        }
        found = audit_part(str(rows["part"].iloc[0]), letters, counted)
        return pd.DataFrame(found, columns=[c.split()[0] for c in AUDIT.split(", ")])

    return masks.groupBy("part").applyInPandas(audit, AUDIT)


#: the filters of ``text_filter_masks``, by bit
TEXT_FILTERS = "ABCDE"


def _text_bits(text: Column) -> Column:
    """Bits of A (short), B (repeats words), C (many capitals) and D (holds symbols)."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    tests = [n < 100, distinct * 100 < n * 80, capitals * 100 > F.length(text).cast("long") * 10, text.rlike(r"[#$%&*|]")]
    bits = [F.when(test, F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def text_filter_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic) of all documents under the filters A to E."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        text.alias("text"),
    )
    same = (
        rows.select("id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("h"), _text_bits(F.col("text")).alias("bits"))
        .groupBy("h", "part", "id").agg(F.count(F.lit(1)).alias("n"), F.first("bits").alias("bits"))
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    weights = [(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    weighted = same.join(marks, "id", "left").select("h", "part", "id", "bits", "n", *weights)
    counts = F.struct("n", "good", "toxic")

    def total(when: Column | None = None) -> Column:
        parts = [F.sum(F.col(c) if when is None else F.when(when, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
        return F.struct(*parts)

    per_text = weighted.groupBy("h", "part").agg(
        F.first("bits").alias("bits"), F.min("id").alias("least"), F.min_by(counts, F.col("id")).alias("first"),
        total().alias("all"), total(F.col("id").isNull()).alias("unnamed"),
    )
    per_text = written(per_text, "audit-texts")
    # a text has at most one row per part here; its smallest id anywhere is no copy
    holder = per_text.groupBy("h").agg(F.min("least").alias("holder"))
    at = per_text.join(holder, "h").withColumn("own", F.coalesce(F.col("least") == F.col("holder"), F.lit(False)))

    def kept(c: str) -> Column:
        return F.when(F.col("own"), F.col(f"first.{c}")).otherwise(0) + F.col(f"unnamed.{c}")

    columns = ("n", "good", "toxic")
    stays = F.struct(F.col("bits").alias("mask"), *[kept(c).alias(c) for c in columns])
    copies = F.struct((F.col("bits") + F.lit(16)).alias("mask"), *[(F.col(f"all.{c}") - kept(c)).alias(c) for c in columns])
    split = at.select("part", F.explode(F.array(stays, copies)).alias("s")).select("part", "s.*").where("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in columns])
