import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from potable.llm import heap_clusters as hc
from potable.llm.filter_audit import AUDIT, CountDiagram, adjacent_swaps, audit_part, filter_audit, text_filter_masks

# ------------------------------------------------------------------ filter audit


def _plain(part, letters, masks):
    """Every order, document counts taken anew at every step."""
    shares, rows = dict.fromkeys(letters, 0), []
    for order in itertools.permutations(letters):
        live = dict(masks)
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            gone = {m: w for m, w in live.items() if m & bit}
            live = {m: w for m, w in live.items() if not m & bit}
            n, good, toxic = ([sum(w[i] for w in d.values()) for d in (gone, live)] for i in range(3))
            shares[letter] += n[0]
            failing = sum(w[0] for m, w in masks.items() if m & bit)
            rows.append([part, "".join(order), step, n[1], n[0], failing - n[0], masks.get(bit, (0, 0, 0))[0], good[0], toxic[0], letter])
    return sorted((*r[:-1], shares[r[-1]]) for r in rows)


@pytest.mark.parametrize("letters", ["A", "AB", "ABC", "ABCD", "ABCDE"])
def test_diagrams_equal_counting_every_order(letters):
    rng = random.Random(len(letters))
    for n_masks in (1, 2, 1 << len(letters)):
        masks = {m: (rng.randint(1, 4), rng.randint(0, 1), rng.randint(0, 1)) for m in rng.sample(range(1 << len(letters)), min(n_masks, 1 << len(letters)))}
        assert sorted(audit_part("p", letters, masks)) == _plain("p", letters, masks)


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == 1 + len(list(adjacent_swaps(n)))


def test_equal_subdiagrams_are_one_node():
    diagram = CountDiagram("ABC", {m: (1, 0, 0) for m in range(8)})
    assert [len(level) for level in diagram.nodes] == [1, 1, 1]
    diagram.swap(0), diagram.swap(1)
    assert diagram.letters == ["B", "C", "A"] and [len(level) for level in diagram.nodes] == [1, 1, 1]


def test_masks_of_texts(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [
        (5, long, "en", "a"), (3, long, "fr", "a"), (3, long, "fr", "a"), (4, long, None, "a"), (None, long, "", "a"),
        (9, None, "en", "a"), (10, "", "en", "a"), (11, "A B", "en", "a"), (12, "a\x0ba #", "en", "a"),
        (13, " ".join(["same"] * 200_000), "en", "a"),
    ]
    labels = spark.createDataFrame(
        [(3, 1, 0), (3, 1, 0), (3, 0, 1), (4, 1, None), (9, 0, 0), (10, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    masks = text_filter_masks(docs_of(rows), labels)
    got = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in masks.collect()}
    assert got == {
        ("en", 16): (1, 0, 0),  # 5: a copy of 3
        ("fr", 0): (2, 2, 2),  # both rows of 3 hold the smallest id
        ("", 16): (1, 1, 0),  # 4
        ("", 0): (1, 0, 0),  # without an id: no copy
        ("en", 1): (1, 0, 0),  # 9: null text, no words
        ("en", 17): (1, 0, 1),  # 10: the same empty text
        ("en", 5): (1, 0, 0),  # 11: capitals
        ("en", 11): (1, 0, 0),  # 12: two of three words are one, apart at a vertical tab
        ("en", 2): (1, 0, 0),  # 13
    }
    audit = filter_audit(masks, "ABCDE")
    rows = [tuple(r) for r in audit.collect()]
    want = [r for part in ("en", "fr", "") for r in _plain(part, "ABCDE", {m: w for (p, m), w in got.items() if p == part})]
    assert sorted(rows) == sorted(want) and len(rows) == 3 * 600
    assert audit.columns == [c.split()[0] for c in AUDIT.split(", ")]


def test_audit_of_an_empty_table(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(text_filter_masks(docs_of([]), labels), "ABCDE").count() == 0


# ------------------------------------------------------------------ clusters


def _lloyd(rows, k, rounds, dimension):
    """Plain rounds over all vectors, in exact integers."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * float(np.float32(x))))) for x in v]))
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    if not centroids:
        return [], []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [nearest(v) for _, v in kept]
    return sorted((-1 if i is None else i, n, min(d, (1 << 63) - 1)) for (i, _), (d, n) in zip(kept, final)), centroids


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, distance long")


def _got(pair):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in pair[0].collect()), pair[1]


def test_clusters_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(hc, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 4))
    rows = [(i, [float(x) for x in (centers[i % 6] + rng.normal(size=4) / 4).round(2)], 1, 1) for i in range(600)]
    rows += [(i, rows[0][1], 1, 1) for i in range(600, 900)]  # a third are one vector: ties
    rows += rows[:40] + [(7, rows[9][1], 1, 1)]  # repeated rows, a repeated id
    rows += [(None, rows[5][1], 1, 1), (950, None, 1, 1), (951, [], 1, 1), (952, [1.0, 2.0, 3.0], 1, 1),
             (953, [float("nan")] * 4, 1, 1), (954, [1.0, None, 1.0, 1.0], 1, 1), (955, [float("-inf")] * 4, 1, 1)]
    got = _got(hc.heap_clusters(_vectors(spark, rows), k=9, rounds=5, dimension=4))
    assert got == _lloyd(rows, 9, 5, 4)
    full = hc.with_inertia(*hc.heap_clusters(_vectors(spark, rows), k=9, rounds=5, dimension=4)).collect()
    own = {c: sum(d for _, n, d in got[0] if n == c) for _, c, _ in got[0]}
    assert all(r["cluster_inertia"] == own[r["cluster"]] and r["inertia"] == sum(own.values()) for r in full)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, got[1][r["cluster"]])).encode()).hexdigest() for r in full)


def test_clusters_of_few_large_or_no_vectors(spark):
    few = [(1, [1.0], 0, 0), (2, [1.0], 0, 0), (3, [-2.5], 0, 0)]
    assert _got(hc.heap_clusters(_vectors(spark, few), k=40, rounds=2, dimension=1)) == _lloyd(few, 40, 2, 1)
    huge = [(i, [x, 1.0], 0, 0) for i, x in enumerate([3e38, -3e38, 1e9, 2.0, 3e9, 5e15, -5e15])]
    assert _got(hc.heap_clusters(_vectors(spark, huge), k=3, rounds=3, dimension=2)) == _lloyd(huge, 3, 3, 2)
    for rows in ([], [(None, [1.0], 0, 0)]):
        found, centroids = hc.heap_clusters(_vectors(spark, rows), dimension=1)
        assert found.count() == 0 and centroids == [] and hc.with_inertia(found, centroids).count() == 0


def test_later_rounds_scan_only_expired_gaps():
    rng = np.random.default_rng(5)
    points = (rng.normal(size=(8, 16)) * 300).repeat(200, axis=0) + rng.normal(size=(1600, 16)) * 20
    block = hc.Block(None, points.astype("<i2"), np.full(1600, -1, dtype=np.int32))
    now = hc.Round([[int(x) for x in points[i]] for i in range(0, 1600, 200)], [0.0] * 8)
    scans = []
    for _ in range(5):
        before = block.scanned
        block.assign(now)
        scans.append(block.scanned - before)
        now = now.moved([[s // n for s in sums] for sums, n in zip(block.sums.tolist(), block.sizes.tolist())])
    assert scans[0] == 1600 and sum(scans[1:]) < 1600
    assert all(heap[0] == min(heap) for heap in block.heaps if heap)
