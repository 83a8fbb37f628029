import math

import numpy as np
from pyspark.sql import functions as F

from potable.llm import kd_search
from potable.llm.line_dedup import line_dedup
from potable.llm.mixing import mix_sources, repeat_documents


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")


def _brute(rows, k=5):
    seen = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = 1
    out = []
    for q, a in seen:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in seen if c != q and len(b) == len(a))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 150)
    monkeypatch.setattr(kd_search, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)], 0, 0) for i in range(500)]
    rows += [(i, rows[0][1], 0, 0) for i in range(500, 620)]  # one common vector: many ties
    rows += [(700, [1.0, 2.0], 0, 0), (701, [0.5, 0.5], 0, 0)]  # another length
    rows += [(None, rows[1][1], 0, 0), (800, None, 0, 0), (801, [], 0, 0), (850, [float("nan")] * 8, 0, 0),
             (851, [1.0, None] + [0.0] * 6, 0, 0), (852, [float("inf")] * 8, 0, 0)]
    rows += rows[40:60]  # repeated rows
    got = kd_search.top_k(_vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_top_k_of_few_large_or_no_vectors(spark):
    few = [(0, [1.0], 0, 0), (1, [2.0], 0, 0)]
    assert [tuple(r) for r in kd_search.top_k(_vectors(spark, few), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    huge = [(0, [3e38, 1.0], 0, 0), (1, [3e38, 1.0], 0, 0), (2, [-3e38, 1.0], 0, 0)]
    got = [tuple(r) for r in kd_search.top_k(_vectors(spark, huge), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert kd_search.top_k(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


LINE = "This line is long enough to be counted as one"


def test_lines_that_many_documents_share(docs_of):
    rows = [(i, f"  {LINE.upper() if i % 2 else LINE}\t\nown {i}") for i in range(5)]
    rows += [(5, None), (6, ""), (7, "x\n\n"), (7, f"{LINE}!\nshort"), (8, f"{LINE}!"), (None, f"{LINE}\nlast")]
    rows += [(4, rows[4][1])]  # a repeated row is the same document
    out = line_dedup(docs_of(rows))
    assert out.columns.count("dedup") == 2  # the clashing column passes through
    got = {}
    for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect():
        got.setdefault(r["c0"], []).append(tuple(r[f"c{len(out.columns) - 1}"]))
    assert got[0] == [("own 0", 2, 1)] and got[3] == [("own 3", 2, 1)]
    assert got[4] == [(f"  {LINE}\t\nown 4", 2, 0)] * 2  # the largest id keeps it
    assert got[None] == [("last", 2, 1)]
    assert got[5] == got[6] == [("", 1, 0)]
    assert sorted(got[7]) == [(f"{LINE}!\nshort", 2, 0), ("x\n\n", 3, 0)]


def test_no_lines_at_all(docs_of):
    assert line_dedup(docs_of([])).count() == 0


def _targets(sizes, weights, share=1.5, cap=2.0):
    left, budget, out = dict(zip(sizes, weights)), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(left.values())
        over = [s for s, w in left.items() if w * level > cap * sizes[s]]
        if not over:
            return out | {s: w * level for s, w in left.items()}
        for s in over:
            out[s] = cap * sizes[s]
            budget -= out[s]
            del left[s]
    return out


def test_targets_and_taken_words(docs_of):
    rows = [(i, "w " * (1 + i % 9), "en", "abcd"[min(i % 7, 3)]) for i in range(400)]
    rows += [(1000 + i, "w w", "en", None) for i in range(30)] + [(2000, None, "en", "zero"), (2001, " \n", "en", "zero")]
    out = mix_sources(docs_of(rows))
    got = [(r[3], *r[-1]) for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()]
    sizes = {}
    for s, size, *_ in got:
        sizes[s] = sizes.get(s, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s))
    expected = _targets({s: sizes[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))])
    taken = dict.fromkeys(order, 0)
    for s, size, total, target, t in got:
        assert total == sizes[s] and abs(target - expected[s]) < 1e-6 * max(1, target) and 0 <= t <= 2 * size
        taken[s] += t
    assert all(abs(taken[s] - expected[s]) <= 9 for s in order)
    again = mix_sources(docs_of(rows))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_the_mix_repeats_documents(docs_of):
    docs = docs_of([(i, "a b c", "en", "s" if i < 3 else "t") for i in range(6)]).drop("mix")
    mixed = mix_sources(docs, weights=(1,), share=2.0)
    assert sorted(r[0] for r in repeat_documents(mixed, docs.columns).select("doc_id").collect()) == sorted([*range(6)] * 2)
    assert mix_sources(docs_of([])).count() == 0
