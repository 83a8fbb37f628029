"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. *Sets.* A document's set is its distinct shingles of ``k`` words, each hashed
   to 64 bits. Documents of equal sets (by two 64-bit sums over the set and its
   size) are one class; the class with the smallest ``doc_id`` stands for it, so a
   group of copies, however large, goes on as one row.
2. *Signatures.* One hash per shingle: its low bits choose one of ``bins``, and
   each bin keeps its smallest hash. An empty bin takes the value of a bin drawn by
   hashing (bin, attempt) until a filled one is met (optimal densification).
3. *Buckets.* ``bands`` bands of ``rows`` bins give bucket keys; buckets of one
   class are dropped by a count.
4. *Star edges.* Each bucket's centre is the member whose buckets hold the most members
   in all (then by a hash of the id). The text that others were made from meets each
   of them more often than they meet each other, so a group agrees on it, or on few
   like it. A member's edge to the centre it shares most buckets with is confirmed on
   the full sets; connected components follow. That is at most one edge per class.
5. *What the stars leave open.* In a bucket whose members are in several
   components, members outside its most frequent component meet the members of
   other components (pairs inside one component decide nothing). Pairs of fitting
   sizes that share at least two buckets are confirmed on the full sets, and
   components are made again. So of the pairs that banding finds, each one is either
   confirmed, refuted, or inside one component already.
   Many pairs may be of variants of one text that are too far from each other. A
   class carries the ``CELLS`` cells that its shingles hash to: an intersection holds
   at most the cells that both use, and the shingles of either that share a cell.
   Pairs whose bound is below the similarity aren't made, so they are refuted exactly.

A link at a similarity of exactly 0.8 shares fewer than two of 40 buckets with
probability 2.5e-6. Confirmation intersects full sets, recomputed from whole texts
for the classes that occur in pairs; centres of many edges are split by AQE's
skew handling (a plain sort-merge join).

Components come from alternating large-star and small-star steps over written
edge tables, never on the driver.

Defined results: documents without words (null, empty, white space) have empty
sets and are linked with nothing; rows of one ``doc_id`` are one document that holds
its rows' classes together; rows with a null id get a null component and aren't
linked; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.llm.common import ship, written
from potable.llm.shingles import shingle_sets
from potable.llm.workers import over_batches

SEED = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def one_permutation(values: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each bin, and which bins hold one."""
    h = mix64(values ^ SEED)
    where = (h % np.uint64(bins)).astype(np.int64)
    low = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(low, where, h)
    full = np.zeros(bins, dtype=bool)
    full[where] = True
    return low, full


def densify(low: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled bin that its own draws meet."""
    empty = np.flatnonzero(~full)
    if not empty.size:
        return low
    bins, attempt = len(low), 1
    out = low.copy()
    while empty.size:
        draw = mix64(empty.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt * int(SEED) % (1 << 64)))
        donor = (draw % np.uint64(bins)).astype(np.int64)
        met = full[donor]
        out[empty[met]] = low[donor[met]]
        empty, attempt = empty[~met], attempt + 1
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band (the band's number is part of it)."""
    grid = signature.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * SEED
    for r in range(rows):
        key = mix64(key ^ grid[:, r])
    return key


#: cells of a set's bitmap (a multiple of 64)
CELLS = 1024


def used_cells(values: np.ndarray) -> np.ndarray:
    """Bitmap of the cells that the hashes fall into, as 64-bit words."""
    bits = np.zeros(CELLS, dtype=np.uint8)
    bits[(mix64(values + SEED) % np.uint64(CELLS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, buckets, cells): size, fingerprint, bucket keys and cells of each document's set."""
    bins = bands * rows

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column(1), k):
                n, f1, f2, keys, cells = [], [], [], [], []
                for s in sets:
                    n.append(len(s))
                    f1.append(mix64(s).sum(dtype=np.uint64))
                    f2.append(mix64(s ^ SEED).sum(dtype=np.uint64))
                    keys.append(band_keys(densify(*one_permutation(s, bins)), bands, rows).view(np.int64) if len(s) else None)
                    cells.append(used_cells(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(np.array(f1, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(f2, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
                        pa.array(cells, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "buckets", "cells"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, buckets array<long>, cells array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles): sorted 64-bit shingle hashes as bytes."""

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column(1), k):
                blobs = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(blobs)), pa.array(blobs, pa.binary())], ["doc_id", "shingles"]
                )

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def common_counts(left: pa.Array, right: pa.Array) -> pa.Array:
    """Sizes of the intersections of sorted sets, pair by pair."""
    out = np.zeros(len(left), dtype=np.int64)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        both = np.concatenate([np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)])
        both.sort(kind="stable")
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return pa.array(out)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose full sets reach the similarity."""

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = common_counts(batch.column("sa"), batch.column("sb"))
            union = pc.subtract(pc.add(batch.column("na"), batch.column("nb")), common)
            keep = pc.greater_equal(pc.multiply(common, 100), pc.multiply(union, percent))
            yield batch.select(["a", "b"]).filter(keep)

    size = (F.octet_length("shingles") / 8).cast("long")
    left = sets.select(F.col("doc_id").alias("a"), size.alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), size.alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(right, ["b", "nb"]).join(left, ["a", "na"])
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _bits(words: list[Column]) -> Column:
    total = F.bit_count(words[0]).cast("long")
    for w in words[1:]:
        total = total + F.bit_count(w)
    return total


def _words(cells: str) -> list[Column]:
    return [F.get(F.col(cells), F.lit(i)) for i in range(CELLS // 64)]


def beside(cells: str, size: str) -> Column:
    """Shingles of a set that share a cell with another of its own."""
    return F.col(size) - _bits(_words(cells))


def most_common(cells_a: str, beside_a: str, cells_b: str, beside_b: str) -> Column:
    """Upper bound of an intersection of two sets."""
    both = [x.bitwiseAND(y) for x, y in zip(_words(cells_a), _words(cells_b), strict=True)]
    return _bits(both) + F.least(beside_a, beside_b)


def sizes_fit(percent: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return (F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node of each node on an edge (a, b)."""
    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        now = written(small.where("u <> v").distinct(), "edges")
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def priority_of(column: str) -> Column:
    return F.xxhash64(F.col(column))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(texts, k, bands, rows), "signatures")
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    fingerprint = ["n_shingles", "f1", "f2"]
    # equal sets have equal bucket keys, so any member's will do
    classes = written(
        linkable.groupBy(*fingerprint).agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"), F.first("cells").alias("cells")), "classes"
    )
    exploded = classes.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("buckets").alias("bucket"))
    shared = written(exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    crowd = written(exploded.join(shared, "bucket"), "bucket-members")
    met = crowd.groupBy("doc_id", "n_shingles").agg(F.sum("n").alias("met"))
    rank = F.struct("met", priority_of("doc_id").alias("p"), F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"))
    centres = crowd.join(met, ["doc_id", "n_shingles"]).groupBy("bucket").agg(F.max(rank).alias("c")).select("bucket", "c.a", "c.na")
    star = (
        crowd.select("bucket", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb")).join(centres, "bucket")
        .where("a <> b or na <> nb")
        .groupBy("a", "na", "b", "nb").agg(F.count("*").alias("n")).where(sizes_fit(percent))
        .groupBy("b", "nb").agg(F.max(F.struct("n", "a", "na")).alias("e"))
        .select("e.a", "b", "e.na", "nb")
    )
    star = written(star, "star-edges")
    found = written(_confirm(star, texts, k, percent), "confirmed-stars")

    labels = components(found)
    labelled = written(
        crowd.select("bucket", "doc_id", "n_shingles")
        .join(labels, F.col("doc_id") == F.col("node"), "left")
        .select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("comp")),
        "labelled",
    )
    several = written(
        labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket"),
        "mixed-buckets",
    )
    mixed = written(labelled.join(several, "bucket"), "mixed-members")
    top = (
        mixed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        .groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("t"))
        .select("bucket", F.col("t.comp").alias("top"))
    )
    mixed = written(mixed.join(written(top, "largest-parts"), "bucket"), "open-members")
    # all bucket keys of a member, so that a pair is made in its first common bucket only
    keys = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "buckets", "cells")
    mixed = mixed.join(keys, ["doc_id", "n_shingles"])
    minor = mixed.where("comp <> top").select(
        "bucket", F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("comp").alias("cx"), F.col("buckets").alias("bx"),
        F.col("cells").alias("px"), beside("cells", "n_shingles").alias("ex"),
    )
    other = mixed.select(
        "bucket", F.col("doc_id").alias("y"), F.col("n_shingles").alias("ny"), F.col("comp").alias("cy"), "top",
        F.col("buckets").alias("by"), F.col("cells").alias("py"), beside("cells", "n_shingles").alias("ey"),
    )
    common, most = F.array_intersect("bx", "by"), most_common("px", "ex", "py", "ey")
    rest = (
        minor.join(other, "bucket")
        # a pair of two minor members is met from its smaller side only
        .where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("top")) | (F.col("x") < F.col("y"))))
        .where((F.least("nx", "ny") * 100) >= (F.greatest("nx", "ny") * percent))
        # most / (nx + ny - most) reaches the similarity
        .where(most * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
        .where((F.size(common) > 1) & (F.get(common, F.lit(0)) == F.col("bucket")))
        .select(F.col("x").alias("a"), F.col("nx").alias("na"), F.col("y").alias("b"), F.col("ny").alias("nb"))
    )
    # pairs that a star edge has tested before go, whichever way round
    tested = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(rest.join(tested, ["a", "b"], "left_anti"), "open-pairs")
    more = _confirm(rest, texts, k, percent)

    # from here on between components: what the open pairs and the rows of one doc_id link
    labels = classes.select("rep").distinct().join(labels, F.col("rep") == F.col("node"), "left").select(
        "rep", F.coalesce("component", "rep").alias("first")
    )
    labels = written(labels, "first-components")
    members = linkable.select("doc_id", *fingerprint).join(classes.drop("buckets", "cells"), fingerprint).select("doc_id", "rep")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi").select("doc_id", "a")
    one_id = members.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    between = more.union(one_id)
    for side in ("a", "b"):
        between = between.join(labels.withColumnRenamed("rep", side), side).withColumn(side, F.col("first")).drop("first")
    final = components(between.select("a", "b"))
    labels = labels.join(final, F.col("first") == F.col("node"), "left").select("rep", F.coalesce("component", "first").alias("component"))
    known = written(classes.drop("buckets", "cells").join(labels, "rep").drop("rep"), "class-components")

    rows = signed.select("doc_id", *fingerprint).join(known, fingerprint, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    )


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirm pairs on the full sets of the documents that occur in them."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    sets = written(full_sets(texts.join(ids, "doc_id", "left_semi"), k), "sets")
    return confirmed(pairs, sets, percent)
