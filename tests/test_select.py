from potable.operators import batching
from potable.operators import select as sel

SCHEMA = "catalog_id string, seq long, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, flag string"


def _entries(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_default_skips_fuzzy_with_text_but_takes_fuzzy_blank(spark):
    e = _entries(spark, [
        ("c", 0, "", "", None, ["Language: uk"], None),
        ("c", 1, "", "Hello", None, ["Старий переклад"], "fuzzy"),
        ("c", 2, "", "World", None, [""], None),
        ("c", 3, "", "Blank", None, [" "], "fuzzy"),
        ("c", 4, "", "%d item", "%d items", ["", "", ""], None),
        ("c", 5, "", "Partial", "Partials", ["one", ""], None),
    ])
    assert [r["msgid"] for r in sel.worklist(e).orderBy("seq").collect()] == ["World", "Blank", "%d item"]
    inc = sel.worklist(e, include_fuzzy=True).orderBy("seq").collect()
    assert [r["msgid"] for r in inc] == ["Hello", "World", "Blank", "%d item"]
    shape = {r["msgid"]: r["req_msgstr"] for r in inc}
    assert shape["Hello"] == [] and shape["World"] is None and shape["%d item"] == ["", "", ""]


def test_context_isolation_and_keys(spark):
    e = _entries(spark, [("c", 1, "auth", "Hello", None, ["Вітаємо"], None), ("c", 2, "", "Hello", None, [""], None)])
    keys = sel.entry_keys(sel.worklist(e)).collect()
    assert [(k["context"], k["msgid"]) for k in keys] == [("", "Hello")]


def test_parser_order_integer_keys_first(spark):
    e = _entries(spark, [
        ("c", 1, "b", "x", None, None, None),
        ("c", 2, "", "b", None, None, None),
        ("c", 3, "10", "y", None, None, None),
        ("c", 4, "", "10", None, None, None),
        ("c", 5, "", "2", None, None, None),
        ("c", 6, "", "01", None, None, None),
        ("c", 7, "2", "z", None, None, None),
    ])
    got = [(r["msgctxt"], r["msgid"]) for r in sel.parser_order(e).orderBy("order_no").collect()]
    assert got == [("2", "z"), ("10", "y"), ("b", "x"), ("", "2"), ("", "10"), ("", "b"), ("", "01")]


def test_batches_of_15(spark):
    rows = [("c", i, "", f"m{i}", None, None, None) for i in range(1, 33)]
    n = batching.number_batches(sel.worklist(_entries(spark, rows)))
    reqs = batching.batch_requests(n).orderBy("batch_no").collect()
    assert [r["n_items"] for r in reqs] == [15, 15, 2]
    assert [i["msgid"] for i in reqs[2]["items"]] == ["m31", "m32"]
    summary = batching.batch_summary(batching.batch_requests(n)).orderBy("batch_no").collect()
    assert summary[2]["progress"] == "Translating batch 3/3 (2 phrases)..."


def test_nothing_to_do(spark):
    e = _entries(spark, [("a", 1, "", "Hi", None, ["x"], None), ("b", 1, "", "Hi", None, [""], None)])
    cats = spark.createDataFrame([("a",), ("b",)], "catalog_id string")
    assert [r[0] for r in sel.nothing_to_do(cats, sel.worklist(e)).collect()] == ["a"]
