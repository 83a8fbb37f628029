import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["catalog_id", "n_entries"]
    rows = df.collect()
    assert len(rows) > 0
    assert all(r["untranslated_after"] <= r["untranslated_before"] for r in rows)


def test_every_query_outside_llm_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}
    assert own == own & set(o)


FAST = [
    "worklist", "batch_requests", "parser_order", "catalog_coverage", "po_headers", "lookup_plural_samples",
    "validate_responses", "committed_prefix", "merge_batches", "po_scan", "incremental_worklist", "po_compile_folded",
    "flagship", "translate_catalog_options",
]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="driver tables missing")
def test_oracle_subset(spark, sf_small):
    res = compare(spark, sf_small, FAST, verbose=True)
    assert {k: v for k, v in res.items() if v != "OK"} == {}
