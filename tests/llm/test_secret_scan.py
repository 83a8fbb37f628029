import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from potable.llm import secret_scan as ss

WORDS = ["order", "number", "customer", "Account", "item_total", "getName", "version2", "http", "Server", "list-view", "address1", "user"]


def _identifier(rng):
    return rng.choice("_-.").join(rng.choice(WORDS) for _ in range(rng.randint(2, 4)))


def _random(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(documents, planted strings by id): ordinary ones of 0-299, secrets by patterns, secrets without any."""
    rng = random.Random(4)
    rows = [(i, " ".join(_identifier(rng) for _ in range(30))) for i in range(300)]
    rows += [(300 + i, f"x token = \"{_random(rng, string.hexdigits[:16], 40)}\" y") for i in range(40)]
    planted = {}
    for i in range(400, 460):
        alphabet = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/")[i % 3]
        value = _random(rng, alphabet, rng.randint(24, 40))
        while not ss.is_candidate(value):
            value = _random(rng, alphabet, 32)
        at = f"{_identifier(rng)} "
        planted[i] = (f"{ss.MODEL}", len(at), len(at) + len(value))
        rows.append((i, f"{at}{value} {_identifier(rng)}"))
    return rows, planted


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _plain_base(text):
    """The three patterns as stated, every match kept or dropped as a whole."""
    found = []
    for number, (kind, pattern, group, least) in enumerate(ss.PATTERNS):
        for m in re.finditer(pattern, text, re.ASCII | (re.I if kind == "assign" else 0)):
            if len(m.group(group)) >= least:
                found.append((m.start(), number, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


TEXTS = [
    "password=abcdefgh PassWD : 'short' secret:abc=defghij api_key\"= \"A.b-c_d/e+f=\" apikey=12345678",
    "é AKIAABCDEFGHIJKL AKIA123 AKIAAKIA12345678XYZ xAKIA0000000000009",
    "0123456789abcdef0123456789abcdef token=0123456789abcdef0123456789abcdef0",
    "token=token=token: abcdefgh", "ſecret=abcdefgh toKen=abcdefgh", "", "\n", "token =\n abcdefgh", None,
    "f" * 300_000 + " token=" + "z" * 200_000, "secret = \"" + "ab cd" * 3,
]


def test_patterns_equal_a_plain_search():
    for text in TEXTS:
        spans = ss.pattern_spans(text or "", ss.compiled_patterns())
        assert [(ss.PATTERNS[n][0], a, b) for a, n, b in spans] == _plain_base(text or "")


def test_markov_chances():
    rng = random.Random(1)
    counts = np.zeros((ss.SIZE,) * 3, dtype=np.int64)
    strings = [_identifier(rng) for _ in range(50)]
    for s in strings:
        at = [ss.END, ss.END, *(ss.SYMBOLS.index(c) for c in s), ss.END]
        for a, b, c in zip(at, at[1:], at[2:]):
            counts[a, b, c] += 1
    model = ss.Markov(counts)
    assert np.allclose(np.exp(model.log.astype(float)).sum(axis=2), 1, atol=1e-4)

    def chance(history, c):  # Witten-Bell, written out
        if history is None:
            return 1 / ss.SIZE
        grams = counts if len(history) == 2 else counts.sum(axis=0) if len(history) == 1 else counts.sum(axis=(0, 1))
        n = grams[tuple(history)] if history else grams
        lower = chance(history[1:] if history else None, c)
        total, kinds = int(n.sum()), int((n > 0).sum())
        return (int(n[c]) + kinds * lower) / (total + kinds) if total else lower

    for s in [*strings[:5], "q9Z=", "order"]:
        at = [ss.END, ss.END, *(ss.SYMBOLS.index(c) for c in s), ss.END]
        want = sum(math.log(chance((a, b), c)) for a, b, c in zip(at, at[1:], at[2:]))
        assert model.score(ss.codes_of(s)) == pytest.approx(want, rel=1e-4)


def test_models_find_random_strings_only(docs_of, labels_of, corpus):
    rows, planted = corpus
    docs = docs_of(rows)
    model = ss.train(docs, labels_of([(i, 1, 0) for i in range(300)]))
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in ss.find_secrets(docs, model).collect()}
    by_model = {i: [s for s in spans if s[0] == ss.MODEL] for i, spans in found.items()}
    assert len(found) == len(rows)
    assert sum(by_model[i] == [planted[i]] for i in planted) >= 0.95 * len(planted)
    assert not any(spans for i, spans in by_model.items() if i not in planted)
    texts = dict(rows)
    assert all([s for s in spans if s[0] != ss.MODEL] == _plain_base(texts[i]) for i, spans in found.items())


def test_defined_results(spark, docs_of, labels_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (0, TEXTS[0]), (90, "ßAb3dE6gH9kL2nP5rS8 Ab3dE6gH9kL2nP5rS8é Ab3dE6gH9kL2nP5rS8.")]
    docs = docs_of(rows)
    labels = labels_of([(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, 1, None)])
    model = ss.train(docs, labels)  # nothing is trusted: equal chances
    assert model.threshold == ss.PRIOR and np.allclose(model.ordinary.log, -math.log(ss.SIZE), atol=1e-5)
    got = ss.span_digest(ss.find_secrets(docs, model)).collect()
    want = sorted(((-1 if i is None else i), *_digest(t)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    own = next(r for r in got if r["doc_id"] == 90)
    assert own["spans"].count(ss.MODEL) <= 1  # only the run without a letter beside it may count
    no_rows, no_labels = docs_of([]), labels_of([])
    assert ss.find_secrets(no_rows, ss.train(no_rows, no_labels)).count() == 0


def _digest(text):
    spans = _plain_base(text or "")
    n = [sum(s[0] == kind for s in spans) for kind, *_ in ss.PATTERNS]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
