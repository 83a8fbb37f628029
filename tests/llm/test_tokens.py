import json
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from potable.llm import token_files
from potable.llm.packing import Limits, pack_documents, pack_examples
from potable.llm.token_counts import SplitMachine, token_counts, token_counter
from potable.llm.word_tokens import text_slices, word_tokens

PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", "r", "v", "l", " ", "\n", "1", "²", "É", "Σ", "!", "<|endoftext|>", "<|", "İ",
          "日本", "́", " ", "\x1c", "\x85", "ß", "한", "ᄀ", "ᅡ", "🙂", "\x00", "Ⅷ", "hello", "World", "'Re", "don't"]
TEXTS = [None, "", " ", "It's 12 o'clock; they'Ll <|endoftext|> go.", "É" * 3000, "a b " * 3000, "'" * 50]


def _ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_ids_and_counts_equal_the_library(word_bpe):
    library = Tokenizer.from_file(word_bpe)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
    def same(texts):
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in word_tokens(word_bpe).encode_texts(texts)] == expected
        assert token_counter(word_bpe).count(texts).tolist() == [len(x) for x in expected]

    same()


def test_cuts_of_long_texts_change_nothing(word_bpe):
    text = "some words, here's more " * 400
    parts = [p for ps, _ in text_slices([text, "", "x" * 500], limit=100) for p in ps]
    assert "".join(parts) == text + "x" * 500 and len(parts) > 50
    whole = _ids(word_bpe, text)
    assert [i for p in parts[:-2] for i in _ids(word_bpe, p)] == whole


def test_state_maps_compose_to_one_run():
    machine = SplitMachine()
    classes = np.random.default_rng(1).integers(0, 10, 5000).astype(np.uint8)
    state, marks = 0, np.zeros(5000, dtype=bool)
    for i, c in enumerate(classes.tolist()):
        at = state * 10 + c
        marks[i] |= bool(machine.mark[at] & 1)
        if i:
            marks[i - 1] |= bool(machine.mark[at] & 2)
        state = machine.go[at]
    assert (machine.starts(classes) == marks).all()


def test_transducer_table_can_start_anew(word_bpe):
    counter = token_counter(word_bpe)
    words = [b"hello", b"internationalisation", "straße".encode(), b"a", b"zzzzzzzzzzzz"]
    before = [counter.words.count(w) for w in words]
    counter.words.clear()
    assert [counter.words.count(w) for w in words] == before


def test_token_counts_rows(docs_of, word_bpe):
    rows = [*enumerate(TEXTS), (None, "x"), (1, "")]
    got = sorted(map(str, token_counts(docs_of(rows), word_bpe, limit=100).collect()))
    sized = [(i, len((t or "").encode()), len(_ids(word_bpe, t))) for i, t in rows]
    assert got == sorted(f"Row(doc_id={i}, n_bytes={b}, n_tokens={n}, over_limit={n > 100})" for i, b, n in sized)
    assert token_counts(docs_of([]), word_bpe).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0), rng.integers(0, 50000, 5000), rng.integers(0, 200, 3000), np.full(1500, 7),
                np.where(rng.random(4000) < 0.05, 2**32 - 1, rng.integers(0, 9, 4000)), rng.integers(0, 2**32, 1025)):
        ids = ids.astype(np.uint32)
        s = token_files.Segment(token_files.write_segment([1, None], [ids[:9], ids[9:]], 3))
        assert (s.ids(0, len(ids)) == ids).all() and s.before == 3
        if len(ids) > 2000:
            assert (s.ids(1020, 1030) == ids[1020:1030]).all()
    small = token_files.write_segment([1], [rng.integers(0, 16, 10240).astype(np.uint32)], 0)
    assert len(small) < 10240  # half a byte an id


def test_token_files(docs_of, word_bpe, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 3000)
    rows = [*enumerate(TEXTS), (None, "first"), (3, "again"), (3, "again"), (-5, "low")]
    got = sorted(map(tuple, token_files.token_files(docs_of(rows), word_bpe, end_id=2).collect()), key=lambda r: r[1])
    expected = {}
    for i, t in rows:
        ids = np.array([*_ids(word_bpe, t), 2], dtype="<u4")
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids)))
    start = 0
    for i, s, n, crc in got:
        assert s == start and (n, crc) in expected[i]
        expected[i].remove((n, crc))
        start += n
    assert not any(expected.values())
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert token_files.token_files(docs_of([]), word_bpe, end_id=2).count() == 0


def test_packing_keeps_the_limits():
    rng = np.random.default_rng(4)
    for limits in (Limits(), Limits(256, 4, 256), Limits(64, 8, 40)):
        sizes = [int(x) + 1 for x in rng.lognormal(4, 1.2, 300)]
        rows = pack_examples(sizes, [max(0, n - 2) for n in sizes], limits)
        spans, padding = {}, 0
        for row in rows:
            used = sum(p[2] for p in row)
            assert used <= limits.tokens and len(row) <= limits.segments and sum(p[3] for p in row) <= limits.loss_tokens
            padding += 0 if used & (used - 1) == 0 else limits.tokens - used
            for i, a, n, _ in row:
                spans.setdefault(i, []).append((a, n))
        for i, n in enumerate(sizes):
            at = 0
            for a, length in sorted(spans[i]):
                assert a == at and length > 0
                at += length
            assert at == n
        assert padding == 0


def test_packed_documents(docs_of, word_bpe):
    rows = [*enumerate(TEXTS), (None, "x y"), (2, " "), (2, " ")]
    got = pack_documents(docs_of(rows), word_bpe, end_id=1).collect()
    assert sum(r.length for r in got) == sum(len(_ids(word_bpe, t)) + 1 for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = np.array([*_ids(word_bpe, TEXTS[4]), 1], dtype="<u4")
    for r in got:
        if r.doc_id == 4:
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length]) and r.doc_tokens == len(whole)
    assert pack_documents(docs_of([]), word_bpe, end_id=1).count() == 0


def test_vocabulary_file_is_of_the_expected_kind(word_bpe):
    model = json.load(open(word_bpe))["model"]
    assert model["end_of_word_suffix"] == "</w>" and len(model["vocab"]) == 512 + len(model["merges"])
