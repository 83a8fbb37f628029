"""Centroid clustering with heap-ordered bounds.

Vectors lie in blocks of at most ``BLOCK_ROWS`` rows, each block one row of a written
table that holds its vectors, their clusters and one heap per cluster. A vector's heap
key is the gap between its distance to the nearest other centroid and that to its own,
plus all drift that its cluster had gathered by then. A cluster's drift grows each
round by its own centroid's move and the longest move of any other. So a key above the
drift proves the nearest centroid unchanged: a round pops only the keys at or below
it, and only those vectors meet all centroids again, exactly.

1. Seeds are the ``k`` vectors with the smallest hashes (one bounded sort).
2. Each round is one Spark job over the blocks, which writes their next state. Sums and
   counts per cluster are kept with each block and changed by the vectors that move;
   one aggregate of k * dimension numbers gives the next centroids on the driver.
3. The last assignment also gives each vector's exact squared distance.

Blocks are cut where rows lie, without a shuffle; state is read from the table of the
round before, so a lost executor costs the tasks it ran. Components are stored as the
smallest integers that hold a block, and distances are computed in doubles where these
are exact (below 2**53), else in integers of any size.

Defined results: components x become floor(256 * x), x as double, clamped to 64 bits;
vectors that are null, have another number of components or hold a null or non-finite
one take no part; repeated rows are vectors of their own; rows without an id are
assigned and counted, but never seeds; equal hashes (repeated ids) are ordered by the
vector; with fewer than k seeds there are fewer clusters; without any seed there are
no rows; ties go to the smaller cluster number, also while a round runs; a cluster
without vectors keeps its centroid; only the id and vector columns are read. Sums of
distances beyond 64 bits are clamped.
"""

from __future__ import annotations

import heapq
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.common import ship, written
from potable.llm.workers import over_batches

BLOCK_ROWS = 2048
#: share by which bounds are widened, far above the rounding of doubles
SLACK = 1e-9
TOP = (1 << 63) - 1
STATE = "ids array<long>, width int, vectors binary, clusters binary, heap_sizes binary, heap_keys binary, heap_rows binary, sums array<string>, sizes array<long>, scanned long"


@dataclass
class Round:
    """What the tasks of a round know: centroids, and the drift gathered per cluster."""

    centroids: list[list[int]]
    drift: list[float]

    def moved(self, centroids: list[list[int]]) -> Round:
        steps = [
            sum((a - b) ** 2 for a, b in zip(old, new, strict=True)) ** 0.5 * (1 + SLACK)
            for old, new in zip(self.centroids, centroids, strict=True)
        ]
        others = [max(steps[:c] + steps[c + 1 :], default=0.0) for c in range(len(steps))]
        return Round(centroids, [d + own + most for d, own, most in zip(self.drift, steps, others, strict=True)])


@dataclass
class Block:
    ids: pa.Array
    vectors: np.ndarray  # integers, a row per vector
    clusters: np.ndarray  # -1 before the first round
    heaps: list[list[tuple[float, int]]] = field(default_factory=list)  # (key, row), as heapq orders them
    sums: np.ndarray | None = None  # integers of any size, a row per cluster
    sizes: np.ndarray | None = None
    scanned: int = 0

    def distances(self, rows: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
        """Exact squared distances of ``rows`` to all centroids."""
        own, theirs = self.vectors[rows], np.array(centroids, dtype=object)
        most = max(abs(int(own.max(initial=0))), abs(int(own.min(initial=0))), max(abs(x) for c in centroids for x in c))
        if 4 * most * most * own.shape[1] < 1 << 53:
            a, b = own.astype(np.float64), theirs.astype(np.float64)
            return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        a = own.astype(object)
        return np.stack([((a - c) ** 2).sum(1) for c in theirs], axis=1)

    def assign(self, now: Round) -> None:
        """Pop the vectors whose gap has expired, rescan them, and push them with new gaps."""
        k = len(now.centroids)
        if self.sums is None:
            self.heaps = [[] for _ in range(k)]
            self.sums, self.sizes = np.zeros((k, self.vectors.shape[1]), dtype=object), np.zeros(k, dtype=np.int64)
            expired = list(range(len(self.vectors)))
        else:
            expired = []
            for heap, drift in zip(self.heaps, now.drift, strict=True):
                limit = drift + SLACK * (1 + drift)
                while heap and heap[0][0] <= limit:
                    expired.append(heapq.heappop(heap)[1])
        self.scanned += len(expired)
        if not expired:
            return
        rows = np.array(expired)
        squares = self.distances(rows, now.centroids)
        best = squares.argmin(axis=1)  # the first of equal ones
        at = np.arange(len(rows))
        near = np.sqrt(squares[at, best].astype(np.float64))
        if k > 1:
            squares[at, best] = squares.max() + 1
            far = np.sqrt(squares.min(axis=1).astype(np.float64))
        else:
            far = np.full(len(rows), np.inf)
        keys = far * (1 - SLACK) - near * (1 + SLACK) - SLACK + np.array(now.drift)[best]
        first = self.clusters[rows[0]] < 0 and len(rows) == len(self.vectors)
        for key, row, cluster in zip(keys.tolist(), expired, best.tolist(), strict=True):
            if first:
                self.heaps[cluster].append((key, row))
            else:
                heapq.heappush(self.heaps[cluster], (key, row))
        if first:
            for heap in self.heaps:
                heapq.heapify(heap)
        before = self.clusters[rows]
        change = before != best
        for c in np.unique(np.concatenate([before[change], best[change]])).tolist():
            gone, come = rows[change & (before == c)], rows[change & (best == c)]
            if c >= 0:
                self.sums[c] += self._sum(come) - self._sum(gone)
                self.sizes[c] += len(come) - len(gone)
        self.clusters[rows] = best

    def _sum(self, rows: np.ndarray) -> np.ndarray:
        part = self.vectors[rows]
        if part.dtype.itemsize == 8:
            part = part.astype(object)
        return part.sum(axis=0, dtype=None if part.dtype == object else np.int64).astype(object) if len(rows) else np.zeros(
            self.vectors.shape[1], dtype=object
        )


def _read(row: dict) -> Block:
    ids = pa.array(row["ids"], pa.int64())
    vectors = np.frombuffer(row["vectors"], dtype=f"<i{row['width']}").reshape(len(ids), -1)
    if row["clusters"] is None:
        return Block(ids, vectors, np.full(len(ids), -1, dtype=np.int32))
    sizes = np.frombuffer(row["heap_sizes"], dtype="<i4")
    keys = np.frombuffer(row["heap_keys"], dtype="<f8").tolist()
    numbers = np.frombuffer(row["heap_rows"], dtype="<i4").tolist()
    ends = np.cumsum(sizes).tolist()
    heaps = [list(zip(keys[e - n : e], numbers[e - n : e], strict=True)) for e, n in zip(ends, sizes.tolist(), strict=True)]
    sums = np.array([int(x) for x in row["sums"]], dtype=object).reshape(len(sizes), -1)
    clusters = np.frombuffer(row["clusters"], dtype="<i4").copy()
    return Block(ids, vectors, clusters, heaps, sums, np.array(row["sizes"], dtype=np.int64))


def _row(block: Block) -> dict:
    out = {"ids": block.ids, "width": block.vectors.dtype.itemsize, "vectors": block.vectors.tobytes()}
    if block.sums is None:
        return out | dict.fromkeys(("clusters", "heap_sizes", "heap_keys", "heap_rows", "sums", "sizes")) | {"scanned": 0}
    flat = [pair for heap in block.heaps for pair in heap]
    return out | {
        "clusters": block.clusters.astype("<i4").tobytes(),
        "heap_sizes": np.array([len(h) for h in block.heaps], dtype="<i4").tobytes(),
        "heap_keys": np.array([key for key, _ in flat], dtype="<f8").tobytes(),
        "heap_rows": np.array([row for _, row in flat], dtype="<i4").tobytes(),
        "sums": [str(x) for x in block.sums.ravel()],
        "sizes": block.sizes.tolist(),
        "scanned": block.scanned,
    }


STATE_TYPES = pa.schema([
    ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()), ("clusters", pa.binary()),
    ("heap_sizes", pa.binary()), ("heap_keys", pa.binary()), ("heap_rows", pa.binary()), ("sums", pa.list_(pa.string())),
    ("sizes", pa.list_(pa.int64())), ("scanned", pa.int64()),
])


def _batch(block: Block) -> pa.RecordBatch:
    row = _row(block)
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in STATE_TYPES], schema=STATE_TYPES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _read({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)})


@over_batches
def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) rows -> rows of ``STATE`` without clusters."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            flat = part.column(1).flatten().to_numpy()
            most = max(abs(int(flat.min())), abs(int(flat.max())))
            width = next(w for w in (2, 4, 8) if w == 8 or most < 1 << (8 * w - 1))
            yield _batch(Block(part.column(0), flat.astype(f"<i{width}").reshape(part.num_rows, -1), np.empty(0)))


def _assigned(blocks: DataFrame, now: Round) -> DataFrame:
    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            block.assign(now)
            yield _batch(block)

    return blocks.mapInArrow(run, STATE)


def _next_centroids(blocks: DataFrame, now: Round) -> list[list[int]]:
    """Exact floor(sum / count) per component; k * dimension sums reach the driver."""
    k, width = len(now.centroids), len(now.centroids[0])

    @over_batches
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros(k * width, dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for own, n in zip(batch.column(0), batch.column(1), strict=True):
                sums += np.array([int(x) for x in own.as_py()], dtype=object)
                sizes += np.array(n.as_py(), dtype=np.int64)
        places = np.arange(k * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array([str(x) for x in sums]), pa.array(np.repeat(sizes, width), pa.int64())],
            ["place", "sum", "size"],
        )

    parts = blocks.select("sums", "sizes").mapInArrow(partial, "place int, sum string, size long")
    total = parts.groupBy("place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("size").alias("size"))
    found = {r["place"]: (int(r["sum"]), r["size"]) for r in total.collect()}
    out = []
    for c, old in enumerate(now.centroids):
        cells = [found.get(c * width + j, (0, 0)) for j in range(width)]
        out.append([s // n for s, n in cells] if cells[0][1] else old)
    return out


def heap_clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dimension: int = 64, seed: int = 2,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector, final centroids).

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id``; ``k``
    times ``dimension`` numbers are what the driver and every task hold.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.where((F.size("e") == dimension) & usable).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * 256.0).cast("long")).alias("vec")
    )
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = rows.where("vec_id is not null").select(named.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    now = Round([list(r["vec"]) for r in seeds], [0.0] * len(seeds))
    blocks = written(rows.mapInArrow(cut_blocks, STATE), "vector-blocks")
    for number in range(rounds):
        blocks = written(_assigned(blocks, now), f"clusters-{number}")
        now = now.moved(_next_centroids(blocks, now))

    @over_batches
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = np.array(now.centroids, dtype=object)
        for block in _blocks(batches):
            block.assign(now)
            own = block.vectors.astype(object) - centroids[block.clusters]
            exact = np.minimum((own * own).sum(axis=1), TOP).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.ids, pa.array(block.clusters, pa.int32()), pa.array(exact, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return written(blocks.mapInArrow(last, "vec_id long, cluster int, distance long"), "clustered"), now.centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 (a small table of k rows is joined)."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), TOP)
    table = [
        (c, min(sums.get(c, 0), TOP), whole, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, centroid in enumerate(centroids)
    ]
    small = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
