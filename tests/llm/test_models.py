import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from potable.llm import context_mixing as cm
from potable.llm.kneser_ney import discounts, grams
from potable.llm.perplexity_rules import base_features, log_probabilities, order_arrays, quality_rules
from potable.llm.quality_classifier import classify_quality

WORDS = "the river runs slowly past old stone houses while people walk home along narrow roads under tall green trees".split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    rows = [(i, _prose(rng, 40 + i % 60), "en", "a") for i in range(240)]
    rows += [(300, None, "en", "a"), (301, "", None, "a"), (302, " \n\t", "fr", "a"), (None, "river stone", "en", "a"), (5, rows[5][1], "en", "a")]
    rows += [(400 + i, "#### $$$ %%% &&& zqx jjk vvw " * 30, "en", "b") for i in range(6)]
    return rows


def _tokens(text):
    return [*(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")), None]


def test_mixing_scores(docs_of, corpus):
    got = cm.score_documents(docs_of(corpus)).collect()
    assert len(got) == len(corpus)
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in corpus]
    c = Counter(w for (_, t, *_), h in zip(corpus, out) if not h for w in _tokens(t))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for (i, t, *_), h in zip(corpus, out):
        w = _tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        expected[i, h, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    prose = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert sum(r.score for r in prose) > sum(r.base_score for r in prose)
    assert cm.score_documents(docs_of([])).count() == 0


def test_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(6)
    tree = cm.Tree.of(rng.integers(0, 1000, 256))
    tables = [rng.integers(0, 1 << 16, 1 << b).astype(np.uint16) for b in cm.BITS]
    model = cm.Model(tree, tables, refined=rng.normal(size=256 * cm.CELLS))
    for _ in range(5):
        past = int(rng.integers(0, 1 << 40))
        code = (past << 8) + np.arange(256, dtype=np.int64)
        word = np.full(256, rng.integers(0, 1 << 60), dtype=np.uint64)
        assert abs((2 ** model.log2(word, code)).sum() - 1) < 1e-9


def test_events_see_the_word_so_far():
    word, code, first = cm.events(pa.array(["ab  cab", "", "cab"]))
    assert np.diff(first).tolist() == [7, 1, 4]
    # "cab" begins alike in both texts, "ab" differs from the "ab" inside "cab"
    assert (word[3:7] == word[8:12]).all() and word[1] != word[5]
    assert (code[0] & 255, code[6] & 255) == (ord("a"), 10)


def test_runs_hold_equal_keys_that_share_their_high_bits():
    rng = np.random.default_rng(7)
    for key in (rng.integers(0, 5, 300), rng.integers(0, 9, 300) << 60, rng.integers(0, 1 << 62, 300), np.zeros(3), np.zeros(0)):
        key = key.astype(np.uint64)
        order, starts = cm.runs(key)
        assert sorted(order.tolist()) == list(range(len(key)))
        assert (np.diff(key[order].astype(object)) >= 0).all()
        assert key[order][starts].tolist() == sorted(set(key.tolist()))
        found, n = cm.merged(key)
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == Counter(key.tolist())


@pytest.mark.parametrize("row_bits", [2, 12])
def test_an_event_is_evaluated_once_while_there_is_room(monkeypatch, row_bits):
    monkeypatch.setattr(cm, "ROW_BITS", row_bits)
    rng = np.random.default_rng(8)
    tables = [rng.integers(0, 1 << 16, 1 << b).astype(np.uint16) for b in cm.BITS]
    model = cm.Model(cm.Tree.of(rng.integers(0, 1000, 256)), tables, refined=rng.normal(size=256 * cm.CELLS))
    made, log2 = [], model.log2
    model.log2 = lambda word, code: made.extend(cm.event_keys(word, code).tolist()) or log2(word, code)
    known = cm.Known()
    for _ in range(3):
        for texts in (["the river", "", "the old river the old river"], ["old stone the river", " "]):
            got, size = model.text_log2(pa.array(texts), known)
            word, code, first = cm.events(pa.array(texts))
            each = log2(word, code)
            assert np.allclose(got, [each[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)], rtol=1e-12)
            assert size.tolist() == np.diff(first).tolist()
    assert (len(made) == len(set(made))) == (row_bits == 12)


def test_kneser_ney_sums_to_one():
    table = Counter()
    for t in ("abracadabra", "banana band", "cabana"):
        for g in grams(pa.array([t]), 3)[0].tolist():
            table[g] += 1
    model = []
    for k in (3, 2, 1):
        keys = np.array(list(table))
        model.append(order_arrays(((keys >> 8) % 32749) * 256 + (keys & 255), np.array(list(table.values()))))
        table = Counter(g & ((1 << (8 * (k - 1))) - 1) for g in table)
    for past in (b"ab", b"zz", b"an"):
        gram = (int.from_bytes(past, "big") << 8) + np.arange(256)
        assert abs(np.exp(log_probabilities(gram, model[::-1])).sum() - 1) < 1e-5


def test_discounts_without_counts_of_counts():
    assert discounts([0, 0, 0, 0]) == (0.5, 0.5, 0.5)
    assert all(0 < d < k for k, d in enumerate(discounts([5, 9, 1, 40]), start=1))


def test_base_counts():
    a, b = "one two three four five six seven eight", "#x *$%& |<> é"
    got = base_features(pa.array([f"{a} {a}\n\nz\nz\n z", b, "", " \n", f"{a}"]))
    assert got["n_words"].tolist() == [19, 4, 0, 0, 8]
    assert got["word_chars"].tolist() == [2 * 32 + 3, 10, 0, 0, 32]
    assert got["n_symbols"].tolist() == [0, 8, 0, 0, 0]
    assert got["n_dup_lines"].tolist() == [1, 0, 0, 0, 0]
    assert got["n_repeat_words"].tolist() == [16, 0, 0, 0, 0]


def test_quality_rules(docs_of, corpus):
    got = {}
    for r in quality_rules(docs_of(corpus)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(corpus)
    assert all(r.kept for i in range(240) for r in got[i]) and len(got[5]) == 2
    assert all(got[i][0].base_failed and not got[i][0].kept for i in (300, 301, 302, None, 400))
    assert quality_rules(docs_of([])).count() == 0


def test_quality_classifier(spark, docs_of, corpus):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200)] + [(400, 1, 0), (400, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = classify_quality(docs_of(corpus), labels).collect()
    assert len(rows) == len(corpus)
    kept = Counter((r.doc_id, r.kept) for r in rows)
    assert sum(kept[i, True] for i in range(240)) >= 235 and not any(kept[i, True] for i in range(400, 406))
    without = classify_quality(docs_of(corpus), labels.limit(0)).collect()
    assert all(r.kept and r.perplexity is None for r in without) and len(without) == len(corpus)
    assert classify_quality(docs_of([]), labels).count() == 0


def _exact_model(texts, order):
    table = Counter(g for t in texts for g in grams(pa.array([t or ""]), order)[0].tolist())
    model = []
    for k in range(order, 0, -1):
        model.append(order_arrays(np.array(list(table)), np.array(list(table.values()))))
        table = Counter(g & ((1 << (8 * (k - 1))) - 1) for g in table)
    return model[::-1]


def test_all_trusted_documents_are_counted(spark, monkeypatch):
    # more trusted documents than a bounded training set would take
    from potable.llm import quality_classifier as qc

    class Enough(Exception):
        pass

    def counted(texts, order):
        raise Enough(texts.where("counted").count(), texts.count())

    monkeypatch.setattr(qc, "count_grams", counted)
    ids = spark.range(210_000).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.lit("a").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    even = ids.where(F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0).count()
    with pytest.raises(Enough) as got:
        classify_quality(docs, ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert even > 100_000 and got.value.args == (even, 210_000)


def test_rules_tell_all_contexts_apart(docs_of):
    """Texts of many scripts have far more contexts than a small table of hashes holds."""
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(map(chr, rng.integers(0x900 + 0x80 * (i % 9), 0x980 + 0x80 * (i % 9), 6))) for _ in range(40)) for i in range(60)]
    model = _exact_model(texts, 5)
    lp = [log_probabilities(grams(pa.array([t]), 5)[0], model) for t in texts]
    got = {r.doc_id: r for r in quality_rules(docs_of([(i, t, str(i), "a") for i, t in enumerate(texts)])).collect()}
    # a language of one document is pulled towards its own mean
    assert all(abs(math.log(got[i].perplexity) + x.mean()) < 1e-9 and got[i].n_bytes == len(x) for i, x in enumerate(lp))


def test_band_rejects_well_formed_garble_of_a_hot_source(docs_of):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    clean = [(i, _prose(rng, 60 + i % 50), "en", f"s{i % 3}") for i in range(200)]
    garbled = [(500 + i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(80)), "en", "hot") for i in range(100)]
    got = {r.doc_id: r for r in quality_rules(docs_of(clean + garbled)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i, *_ in garbled)
    assert sum(got[i].kept for i, *_ in clean) >= 199


def test_labels_choose_both_sides_and_rare_languages_stay(spark, docs_of):
    rng = random.Random(12)
    other = "der alte fluss fließt langsam vorbei an steinernen häusern während menschen abends nach hause gehen".split()
    clean = [(i, _prose(rng, 60 + i % 50), "en", f"s{i % 3}") for i in range(240)]
    rare = [(1000 + i, " ".join(rng.choices(other, k=60 + i)), "de", "r") for i in range(30)]
    repeats = [(500 + i, " ".join([rng.choice(["slowly", "houses", "people", "narrow"])] * (80 + i)), "en", "t") for i in range(40)]
    labels = [(i, 1, 0) for i in range(200)] + [(500 + i, 0, 0) for i in range(20)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify_quality(docs_of(clean + rare + repeats), labels).collect()}
    # templated junk is no surprise to the model, and half of it has no label
    assert sum(not got[i].kept for i, *_ in repeats) >= 30
    assert sum(got[i].kept for i, *_ in clean) >= 239
    assert all(got[i].kept for i, *_ in rare)
