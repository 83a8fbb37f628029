import public_tokenizers
import pytest

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, part int, block int, dedup string, mix string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (id, text, lang, source) tuples, with extra columns that clash."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, lang, source = (*r, "en", "a")[:4] if len(r) == 2 else r
            full.append((doc_id, text, lang, source, len(text or ""), 1, 2, 3, "x", "y"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def word_bpe():
    return WORD_BPE
