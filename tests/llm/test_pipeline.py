import corpus_pipeline as C
import numpy as np

from potable.llm.common import documents

SHARED = "This passage is long enough and stands in many of the documents here"


def test_each_stage_does_its_work(spark, tmp_path):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, 80))
        rows.append((i, text + ("\n" + SHARED if i % 10 == 0 else ""), "en", f"s{i % 3}"))
    rows += [(200 + i, rows[i * 7 + 1][1], "en", "s1") for i in range(5)]  # copies
    rows += [(300 + i, "#### $$$ %%% &&& " * 40, "en", "s2") for i in range(4)]  # junk
    full = [(d, t, lang, s, len(t)) for d, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = documents(spark, str(tmp_path)), []
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, docs))
    by = dict(seen)
    ids = {n: {r.doc_id for r in d.collect()} for n, d in by.items()}
    assert all(d.columns == C.COLUMNS for n, d in by.items() if n != "packing")
    assert not any(i >= 300 for i in ids["quality classifier"]) and len([i for i in ids["quality classifier"] if i < 120]) >= 116
    kept = [r.doc_id for r in by["line dedup"].where(by["line dedup"].text.contains(SHARED)).collect()]
    assert kept == [max(i for i in ids["quality classifier"] if i < 120 and i % 10 == 0)]
    assert ids["line dedup"] == ids["quality classifier"]
    assert not any(200 <= i < 300 for i in ids["near duplicates"]) and ids["near duplicates"] >= {i for i in ids["line dedup"] if i < 120}
    assert ids["mixing"] <= ids["near duplicates"]
    pieces = by["packing"].collect()
    assert {r.doc_id for r in pieces} == ids["mixing"]
    assert sum(r.length for r in pieces) == sum(
        r.doc_tokens for r in pieces if r.start == 0
    )
