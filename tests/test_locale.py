from potable.operators.locale import parse_headers, plural_sample_dim, samples_text, with_language_fields


def test_plural_samples_from_rules(spark):
    dim = {r["code"]: r["t"] for r in plural_sample_dim(spark).select("code", samples_text("samples").alias("t")).collect()}
    assert dim["uk"] == "0:1,1:2,2:5"
    assert dim["en"] == "0:1,1:2" and dim["fr"] == "0:1,1:2"
    assert dim["ja"] == "0:1"
    assert dim["ar"].startswith("0:0,1:1,2:2,3:3,4:11,5:100")


def test_headers_and_language_fields(spark):
    rows = [
        ("a", "Language: uk\nPlural-Forms: nplurals=3;\n"),
        ("b", "Plural-Forms: x\n"),
        ("c", "Language: \n"),
        ("d", "language: de_DE\nplural-forms: y\nmime-version: 1.0\n"),
        ("e", "Language: xx\nLanguage: \t fr extra \n"),
    ]
    cats = spark.createDataFrame(rows, "catalog_id string, header_text string").withColumn("headers", parse_headers("header_text"))
    got = {r["catalog_id"]: r for r in with_language_fields(cats).collect()}
    assert got["a"]["target_language"] == "uk" and got["a"]["formula"] == "nplurals=3;"
    assert got["b"]["language"] is None and got["b"]["target_language"] == "en"
    assert got["c"]["target_language"] == "" and got["c"]["formula"] == ""
    assert got["d"]["headers"]["MIME-Version"] == "1.0" and got["d"]["locale"] == "de_DE"
    assert got["e"]["target_language"] == "fr extra" and got["e"]["locale"] == "fr"


def test_source_languages_are_the_iso_codes(spark):
    from potable.operators.locale import ISO_639_1, invalid_source_languages, valid_source_languages

    assert len(ISO_639_1) == len(set(ISO_639_1)) == 183
    rows = spark.createDataFrame([(c,) for c in (" CY ", "la", "zu", "fil", "zz", "en-gb", "")], "source_lang string")
    assert {r[0] for r in valid_source_languages(rows).collect()} == {" CY ", "la", "zu"}
    assert {r[0] for r in invalid_source_languages(rows).collect()} == {"fil", "zz", "en-gb", ""}
