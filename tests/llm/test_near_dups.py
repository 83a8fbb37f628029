import random
import re

from potable.llm.near_dups import densify, near_duplicates, one_permutation
import numpy as np


def _brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i if i is not None else -1), len(s), find(i) if i is not None else -1) for (i, _), s in zip(rows, sets))


def _family(rng, n, members, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(members):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(n)] = f"x{rng.randrange(5000)}"
        yield " ".join(w)


def test_components_equal_brute_force(docs_of):
    rng = random.Random(8)
    texts = [t for n, m, c in ((60, 60, 2), (200, 20, 8), (30, 12, 1), (9, 8, 1), (6, 4, 0)) for t in _family(rng, n, m, c)]
    texts += [texts[3]] * 40 + [texts[3].upper().replace(" ", "\n")]  # copies
    # a chain: each is near to the next only
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i * 3 : i * 3 + 60]) for i in range(12)]
    texts += [None, "", " \t", "one", "ONE", "two words", "a b c d", "a b c"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t) for i, t in zip(order, texts)]
    rows += [rows[0], rows[0], (None, texts[0])]  # repeated rows, no id
    rows += [(rows[1][0], texts[100])]  # one id holds two families together
    for k, percent in ((4, 80), (5, 80)):
        out = near_duplicates(docs_of(rows), k=k, percent=percent).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)
        assert got == _brute(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_no_documents(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    assert near_duplicates(docs_of([(1, None)])).collect()[0].kept


def test_densified_bins_agree_as_often_as_sets_do():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 62, 10).astype(np.uint64)
    b = np.concatenate([a[:9], rng.integers(0, 1 << 62, 1).astype(np.uint64)])
    same = np.mean([(densify(*one_permutation(a ^ s, 200)) == densify(*one_permutation(b ^ s, 200))).mean()
                    for s in rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    assert abs(same - 9 / 11) < 0.03
