"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows by a hash of their content.
A shard's tree splits at the median of the widest dimension; each node has the
tight box of its points, and its smallest id for ties. The largest inner product
that a box allows is the sum over dimensions of the better of its two corners.

1. Each query is searched in one shard (its own). Its k-th best score and id there
   are its bound.
2. Queries, in blocks of ``BLOCK_ROWS``, meet all other shards with that bound. A
   query walks down the nodes whose box can still beat the bound; the leaves it
   reaches are visited best box first, and the bound rises with every leaf.
3. The candidates of both passes are ranked per query.

A task holds one shard and one block of queries.

Defined results: components x become floor(256 * x) as integers; vectors that are
null, empty or hold a null or non-finite component take no part, nor do rows
without an id; equal rows (id and vector) count once; different vectors of one id
are candidates of their own, but never each other's; vectors of different length
never meet; ties go to the smaller id; fewer than k candidates are all returned; an
empty table gives an empty result; only the id and vector columns are read. Where
components are so large that a sum may pass 2**53, scores come from exact
integers without a tree, and are clamped to 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potable.llm.common import ship, written
from potable.llm.workers import over_pair

SHARD_ROWS = 4096
BLOCK_ROWS = 2048
LEAF = 32
NO_ID = np.iinfo(np.int64).max


class KDTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaf: list[int] = []
        spans: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            number = len(self.low)
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(ids[order[a:b]].min()))
            self.children.append(None)
            self.leaf.append(-1)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (number, pair[1]) if side == 0 else (pair[0], number)
            if b - a <= LEAF:
                self.leaf[number] = len(spans)
                spans.append((a, b))
                continue
            axis = int((high - low).argmax())
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
            todo.append((a, a + middle, number, 0))
            todo.append((a + middle, b, number, 1))
        # leaves as equal blocks, filled up with points that lose every comparison
        self.points = np.zeros((len(spans), LEAF, points.shape[1]))
        self.ids = np.full((len(spans), LEAF), NO_ID, dtype=np.int64)
        for i, (a, b) in enumerate(spans):
            self.points[i, : b - a] = points[order[a:b]]
            self.ids[i, : b - a] = ids[order[a:b]]

    def reach(self, queries: np.ndarray, bound: np.ndarray, bound_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, box bound) of the leaves that may hold something better than the bounds."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, active = todo.pop()
            most = up[active] @ self.high[node] + down[active] @ self.low[node]
            may = (most > bound[active]) | ((most == bound[active]) & (self.least[node] < bound_id[active]))
            active, most = active[may], most[may]
            if not len(active):
                continue
            if self.children[node] is None:
                found.append((active, np.full(len(active), self.leaf[node]), most))
            else:
                todo += [(child, active) for child in self.children[node]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]

    def search(
        self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, bound_id: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Per query the k best (scores, ids) that beat its bound; an id never meets itself."""
        scores = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), NO_ID, dtype=np.int64)
        bound, bound_id = bound.copy(), bound_id.copy()
        query, leaf, most = self.reach(queries, bound, bound_id)
        order = np.lexsort((-most, query))
        query, leaf, most = query[order], leaf[order], most[order]
        turn = np.arange(len(query)) - np.searchsorted(query, query)
        by_turn = np.argsort(turn, kind="stable")
        ends = np.cumsum(np.bincount(turn)) if len(turn) else []
        begin = 0
        for end in ends:  # each query's best box left, then its next, and so on
            at = by_turn[begin:end]
            begin = end
            q, b = query[at], most[at]
            at = at[(b > bound[q]) | (b == bound[q])]
            if not len(at):
                continue
            q, lf = query[at], leaf[at]
            new_ids = np.where(self.ids[lf] == own[q][:, None], NO_ID, self.ids[lf])
            new = np.matmul(self.points[lf], queries[q][:, :, None])[:, :, 0]
            new = np.where(new_ids == NO_ID, -np.inf, new)
            all_scores, all_ids = np.concatenate([scores[q], new], axis=1), np.concatenate([ids[q], new_ids], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[q], ids[q] = np.take_along_axis(all_scores, best, axis=1), np.take_along_axis(all_ids, best, axis=1)
            last, last_id = scores[q, k - 1], ids[q, k - 1]
            better = (last > bound[q]) | ((last == bound[q]) & (last_id < bound_id[q]))
            bound[q], bound_id[q] = np.where(better, last, bound[q]), np.where(better, last_id, bound_id[q])
        return scores, ids


def exact_scores(points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """Best (score, id) by integers of any size."""
    sums = points.astype(object) @ query.astype(object)
    limit = (1 << 63) - 1
    rows = [(max(-limit - 1, min(limit, int(s))), int(i)) for s, i in zip(sums, ids, strict=True) if i != own]
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


def matrices(table: pa.Table, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrix by vector length."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out[d] = (rows, flat[first[rows][:, None] + np.arange(d)])
    return out


def search_shard(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
    if queries.num_rows and vectors.num_rows:
        q_ids, q_keys = queries.column("query_id").to_numpy(), queries.column("query_key").to_numpy()
        has = queries.column("bound").is_valid().to_numpy()
        bounds = np.where(has, queries.column("bound").fill_null(0).to_numpy().astype(np.float64), -np.inf)
        bound_ids = np.where(has, queries.column("bound_id").fill_null(0).to_numpy(), NO_ID)
        v_ids = vectors.column("vec_id").to_numpy()
        theirs = matrices(vectors, "vec")
        for d, (rows, q) in matrices(queries, "query").items():
            if d not in theirs:
                continue
            v_rows, v = theirs[d]
            ids = v_ids[v_rows]
            own = q_ids[rows]
            top = float(np.abs(v.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * d
            if top >= 2.0**53:
                found = [[(s, i) for s, i in exact_scores(v, ids, q[r], own[r], k)] for r in range(len(rows))]
            else:
                s, i = KDTree(v.astype(np.float64), ids).search(q.astype(np.float64), own, bounds[rows], bound_ids[rows], k)
                found = [[(int(a), int(b)) for a, b in zip(x, y, strict=True) if b != NO_ID] for x, y in zip(s, i, strict=True)]
            for r, pairs in zip(rows.tolist(), found, strict=True):
                for score, vec_id in pairs:
                    for column, value in zip(out.values(), (q_ids[r], q_keys[r], vec_id, score), strict=True):
                        column.append(value)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


RESULT = "query_id long, query_key long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row's k best other rows; ``is_query`` is over ``vec_id``."""
    spark = vectors.sparkSession
    ship(spark)
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("e") > 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = (
        rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & usable)
        .select("vec_id", F.transform("e", lambda x: F.floor(x * 256.0).cast("long")).alias("vec"))
        .distinct()
        .withColumn("key", F.xxhash64("vec"))
    )
    rows = written(rows, "vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "key"), F.lit(shards)).cast("int"))
    queries = rows.where(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), F.col("vec").alias("query"), F.col("shard").alias("home")
    )
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    spot = F.struct("shard", "block")

    @over_pair
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_shard(left, right, k)

    def found(asked: DataFrame, offered: DataFrame) -> DataFrame:
        asked = asked.withColumn("spot", spot).drop("shard", "block", "home")
        offered = offered.withColumn("spot", spot).select("spot", "vec_id", "vec")
        return asked.groupBy("spot").cogroup(offered.groupBy("spot")).applyInArrow(search, RESULT)

    nothing = F.lit(None).cast("long")
    in_block = F.pmod(F.xxhash64("query_key", "query_id"), F.lit(blocks)).cast("int")
    first = found(
        queries.withColumn("shard", F.col("home")).withColumn("block", F.lit(0)).withColumn("bound", nothing).withColumn("bound_id", nothing),
        rows.withColumn("block", F.lit(0)),
    )
    first = written(first, "home-results")
    by_query = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    bound = first.withColumn("r", F.row_number().over(by_query)).where(F.col("r") == k).select(
        "query_id", "query_key", F.col("score").alias("bound"), F.col("vec_id").alias("bound_id")
    )
    asked = (
        queries.join(bound, ["query_id", "query_key"], "left")
        .withColumn("block", in_block)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .where("shard <> home")
    )
    offered = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    candidates = first.union(found(asked, offered))
    return (
        candidates.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
