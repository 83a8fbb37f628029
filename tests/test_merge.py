from pyspark.sql import functions as F

from potable.operators.merge import add_fuzzy, apply_translations, clear_fuzzy, mark_machine_translated


def _col(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_mark_machine_translated(spark):
    got = _col(spark, mark_machine_translated, [None, "", "TODO: review wording", "ai-translated", " ai-translated \r\nx", "  "])
    assert got == [
        "ai-translated", "ai-translated", "TODO: review wording\nai-translated", "ai-translated",
        " ai-translated \r\nx", "  \nai-translated",
    ]


def test_add_fuzzy(spark):
    got = _col(spark, add_fuzzy, [None, "", "c-format", "fuzzy", "c-format,Fuzzy", " a , ,b"])
    assert got == ["fuzzy", "fuzzy", "c-format, fuzzy", "fuzzy", "c-format,Fuzzy", "a, b, fuzzy"]


def test_clear_fuzzy(spark):
    got = _col(spark, clear_fuzzy, [None, "", "fuzzy", "fuzzy,,c-format", "c-format,  FUZZY", "a,b"])
    assert got == [None, "", None, ", c-format", "c-format", "a, b"]


def test_apply_translations_by_context_and_last_wins(spark):
    entries = spark.createDataFrame(
        [("c", 1, "auth", "Hello", ["Вітаємо"], None, None), ("c", 2, "", "Hello", [""], "fuzzy", None)],
        "catalog_id string, seq long, msgctxt string, msgid string, msgstr array<string>, flag string, translator string",
    )
    results = spark.createDataFrame(
        [("c", 1, 0, "", "Hello", ["first"]), ("c", 2, 0, None, "Hello", ["Привіт"]), ("c", 1, 1, "x", "Nope", ["y"])],
        "catalog_id string, batch_no long, pos int, msgctxt string, msgid string, msgstr array<string>",
    )
    out = {r["msgctxt"]: r for r in apply_translations(entries, results).collect()}
    assert out["auth"]["msgstr"] == ["Вітаємо"] and out["auth"]["translator"] is None
    assert out[""]["msgstr"] == ["Привіт"] and out[""]["translator"] == "ai-translated"
    # default mode keeps the fuzzy flag of a fuzzy-and-blank entry
    assert out[""]["flag"] == "fuzzy"
    both = {r["msgctxt"]: r for r in apply_translations(entries, results, include_fuzzy=True, add_fuzzy_flag=True).collect()}
    assert both[""]["flag"] == "fuzzy"
    cleared = {r["msgctxt"]: r for r in apply_translations(entries, results, include_fuzzy=True).collect()}
    assert cleared[""]["flag"] is None
