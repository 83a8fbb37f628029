from pyspark.sql import functions as F

from potable.functions.text import integer_key_value, is_blank, is_fuzzy, is_untranslated, js_trim, placeholders


def _one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_js_trim_whitespace_set(spark):
    data = [("\t a \n",), (" x\ufeff",), ("\u0085y\u0085",), ("  z \u3000",), ("\u00a0",)]
    out = _one(spark, js_trim("s"), data, "s string")
    # U+0085 is not JS whitespace; Spark's own trim would keep NBSP/BOM
    assert out == ["a", "x", "\u0085y\u0085", "z", ""]


def test_is_untranslated_rules(spark):
    data = [(None,), ([],), ([""],), (["\t "],), (["", "x"],), (["t"],), ([None],), ([" ", None],)]
    out = _one(spark, is_untranslated("m"), data, "m array<string>")
    # partial plurals count as translated; null forms count as blank
    assert out == [True, True, True, True, False, False, True, True]


def test_is_fuzzy_tokens(spark):
    data = [("fuzzy",), ("c-format, fuzzy",), (" Fuzzy ",), ("fuzzy-ish",), ("",), (None,), ("c-format",), ("fuzzy\nc-format",)]
    out = _one(spark, is_fuzzy("f"), data, "f string")
    assert out == [True, True, True, False, False, False, False, False]


def test_is_blank_null(spark):
    assert _one(spark, is_blank("s"), [(None,), ("a",)], "s string") == [True, False]


def test_integer_like_keys(spark):
    data = [("7",), ("01",), ("10",), ("4294967294",), ("4294967295",), ("b",), ("",)]
    out = _one(spark, integer_key_value("k"), data, "k string")
    assert out == [7, None, 10, 4294967294, None, None, None]


def test_placeholders(spark):
    data = [("Hi %s, you have %d items and %(n)s {name} ${x} <b>bold</b> 100%%",)]
    out = _one(spark, F.array_join(placeholders("s"), " "), data, "s string")
    assert out == ["${x} %(n)s %d %s </b> <b> {name}"]


def test_only_the_end_of_the_text_ends_a_match(spark):
    from potable.functions.text import is_blank, is_integer_key, js_trim, placeholders

    row = spark.sql("select '\\u0085' as nel, 'a \\u0085' as tail, '7\\n' as key, '50% discount' as pct").select(
        is_blank("nel").alias("b"), js_trim("tail").alias("t"), is_integer_key("key").alias("k"), placeholders("pct").alias("p")
    ).first()
    assert (row.b, row.t, row.k, row.p) == (False, "a \u0085", False, [])
