"""Catalog header, language and plural-form operators.

The language dimension is a fixed, small table (one row per language code), so
joining it is a broadcast with a proven size bound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.functions.text import js_trim

# Gettext plural rule families. name -> (nplurals, Plural-Forms
# formula, the same rule as a SQL expression over integer ``n``).
PLURAL_RULES: dict[str, tuple[int, str, str]] = {
    "one": (1, "nplurals=1; plural=0;", "0"),
    "not_one": (2, "nplurals=2; plural=(n != 1);", "CASE WHEN n <> 1 THEN 1 ELSE 0 END"),
    "above_one": (2, "nplurals=2; plural=(n > 1);", "CASE WHEN n > 1 THEN 1 ELSE 0 END"),
    "east_slavic": (
        3,
        "nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);",
        "CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 "
        "WHEN n % 10 >= 2 AND n % 10 <= 4 AND (n % 100 < 10 OR n % 100 >= 20) THEN 1 ELSE 2 END",
    ),
    "west_slavic": (
        3,
        "nplurals=3; plural=(n==1) ? 0 : (n>=2 && n<=4) ? 1 : 2;",
        "CASE WHEN n = 1 THEN 0 WHEN n >= 2 AND n <= 4 THEN 1 ELSE 2 END",
    ),
    "polish": (
        3,
        "nplurals=3; plural=(n==1 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);",
        "CASE WHEN n = 1 THEN 0 WHEN n % 10 >= 2 AND n % 10 <= 4 AND (n % 100 < 10 OR n % 100 >= 20) THEN 1 ELSE 2 END",
    ),
    "latvian": (
        3,
        "nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n != 0 ? 1 : 2);",
        "CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 WHEN n <> 0 THEN 1 ELSE 2 END",
    ),
    "lithuanian": (
        3,
        "nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && (n%100<10 || n%100>=20) ? 1 : 2);",
        "CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 WHEN n % 10 >= 2 AND (n % 100 < 10 OR n % 100 >= 20) THEN 1 ELSE 2 END",
    ),
    "romanian": (
        3,
        "nplurals=3; plural=(n==1 ? 0 : (n==0 || (n%100 > 0 && n%100 < 20)) ? 1 : 2);",
        "CASE WHEN n = 1 THEN 0 WHEN n = 0 OR (n % 100 > 0 AND n % 100 < 20) THEN 1 ELSE 2 END",
    ),
    "irish": (
        3,
        "nplurals=3; plural=n==1 ? 0 : n==2 ? 1 : 2;",
        "CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 END",
    ),
    "slovenian": (
        4,
        "nplurals=4; plural=(n%100==1 ? 0 : n%100==2 ? 1 : n%100==3 || n%100==4 ? 2 : 3);",
        "CASE WHEN n % 100 = 1 THEN 0 WHEN n % 100 = 2 THEN 1 WHEN n % 100 = 3 OR n % 100 = 4 THEN 2 ELSE 3 END",
    ),
    "arabic": (
        6,
        "nplurals=6; plural=(n==0 ? 0 : n==1 ? 1 : n==2 ? 2 : n%100>=3 && n%100<=10 ? 3 : n%100>=11 ? 4 : 5);",
        "CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 "
        "WHEN n % 100 >= 3 AND n % 100 <= 10 THEN 3 WHEN n % 100 >= 11 THEN 4 ELSE 5 END",
    ),
}

# Language code -> plural rule family.
LANGUAGES: dict[str, str] = {
    "af": "not_one", "am": "above_one", "ar": "arabic", "az": "not_one", "be": "east_slavic",
    "bg": "not_one", "bn": "not_one", "bs": "east_slavic", "ca": "not_one", "cs": "west_slavic",
    "da": "not_one", "de": "not_one", "el": "not_one", "en": "not_one", "eo": "not_one",
    "es": "not_one", "et": "not_one", "eu": "not_one", "fa": "above_one", "fi": "not_one",
    "fil": "above_one", "fo": "not_one", "fr": "above_one", "ga": "irish", "gl": "not_one",
    "gu": "not_one", "he": "not_one", "hi": "not_one", "hr": "east_slavic", "hu": "not_one",
    "hy": "not_one", "id": "one", "is": "not_one", "it": "not_one", "ja": "one",
    "ka": "not_one", "kk": "not_one", "km": "one", "kn": "not_one", "ko": "one",
    "lo": "one", "lt": "lithuanian", "lv": "latvian", "mk": "not_one", "ml": "not_one",
    "mn": "not_one", "mr": "not_one", "ms": "one", "nb": "not_one", "ne": "not_one",
    "nl": "not_one", "nn": "not_one", "no": "not_one", "oc": "above_one", "pa": "not_one",
    "pl": "polish", "pt": "not_one", "ro": "romanian", "ru": "east_slavic", "si": "not_one",
    "sk": "west_slavic", "sl": "slovenian", "sq": "not_one", "sr": "east_slavic", "sv": "not_one",
    "sw": "not_one", "ta": "not_one", "te": "not_one", "th": "one", "tr": "not_one",
    "uk": "east_slavic", "ur": "not_one", "uz": "not_one", "vi": "one", "zh": "one",
}

# The two-letter codes of ISO 639-1.
ISO_639_1 = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es "
    "et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki "
    "kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no "
    "nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te "
    "tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()

SAMPLE_SEARCH_MAX = 200


def _rule_at(var: str) -> str:
    arms = []
    for name, (_, _, expr) in PLURAL_RULES.items():
        arms.append(f"WHEN family = '{name}' THEN ({_subst(expr, var)})")
    return "(CASE " + " ".join(arms) + " END)"


def _subst(expr: str, var: str) -> str:
    # rules are written over the identifier ``n``; rename it for lambdas
    return re.sub(r"\bn\b", var, expr)


def language_dim(spark: SparkSession) -> DataFrame:
    """code, family, nplurals, formula (one row per known language)."""
    rows = [(code, fam, PLURAL_RULES[fam][0], PLURAL_RULES[fam][1]) for code, fam in LANGUAGES.items()]
    return spark.createDataFrame(rows, "code string, family string, nplurals int, formula string")


def samples_expr() -> Column:
    """Per row with ``family``/``nplurals``: smallest count >= 1 reaching each form
    (0 when only n = 0 reaches it), as ``array<struct<plural:int,sample:int>>``."""
    rule_k = _rule_at("k")
    rule_0 = _rule_at("0")
    sql = (
        "transform(sequence(0, nplurals - 1), f -> named_struct("
        "'plural', f, "
        f"'sample', coalesce(array_min(filter(sequence(1, {SAMPLE_SEARCH_MAX}), k -> {rule_k} = f)), "
        f"CASE WHEN {rule_0} = f THEN 0 END)))"
    )
    return F.expr(sql)


def plural_sample_dim(spark: SparkSession) -> DataFrame:
    """code, family, nplurals, formula, samples — computed from the rule, not listed."""
    return language_dim(spark).withColumn("samples", samples_expr())


def samples_text(col: Column | str) -> Column:
    """``0:1,1:2,2:5`` rendering of a samples array (oracle-friendly scalar)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(
        F.transform(c, lambda s: F.concat(s["plural"].cast("string"), F.lit(":"), s["sample"].cast("string"))),
        ",",
    )


# --------------------------------------------------------------------------- headers


def parse_headers(header_text: Column | str) -> Column:
    """Header entry ``msgstr`` -> ``map<string,string>``.

    Lines split on ``\\n``; key = text before the first ``:`` (normalised), value =
    the rest (JS-trimmed); keyless lines are skipped; a repeated key keeps its
    last value.
    """
    c = F.col(header_text) if isinstance(header_text, str) else header_text

    def pair(line: Column) -> Column:
        low = F.lower(js_trim(F.substring_index(line, ":", 1)))
        words = F.array_join(
            F.transform(F.split(low, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
            "-",
        )
        key = (
            F.when(low.startswith("mime"), F.concat(F.lit("MIME"), F.substring(words, 5, 1 << 30)))
            .when(low.startswith("pot-"), F.concat(F.lit("POT"), F.substring(words, 4, 1 << 30)))
            .when(low.startswith("po-"), F.concat(F.lit("PO"), F.substring(words, 3, 1 << 30)))
            .otherwise(words)
        )
        value = F.when(F.instr(line, ":") > 0, js_trim(F.substring(line, F.instr(line, ":") + 1, 1 << 30)))
        return F.struct(key.alias("key"), F.coalesce(value, F.lit("")).alias("value"))

    pairs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), pair), lambda p: p["key"] != F.lit(""))
    # keep the last occurrence of each key
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]),
    )
    return F.map_from_entries(last)


def header_value(headers: Column | str, key: str) -> Column:
    """``headers[key]`` or null when absent (``undefined`` in the reference)."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.try_element_at(h, F.lit(key))


def target_language(language: Column | str) -> Column:
    """Language sent to the model: only a missing header defaults to ``en``."""
    c = F.col(language) if isinstance(language, str) else language
    return F.coalesce(c, F.lit("en"))


def target_formula(plural_forms: Column | str) -> Column:
    c = F.col(plural_forms) if isinstance(plural_forms, str) else plural_forms
    return F.coalesce(c, F.lit(""))


def normalized_locale(target: Column | str) -> Column:
    """JS-trim, then the first whitespace-separated token (case and region kept)."""
    c = F.col(target) if isinstance(target, str) else target
    return F.split(js_trim(c), "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]")[0]


def with_language_fields(catalogs: DataFrame) -> DataFrame:
    """catalogs(headers) + language, plural_forms, target_language, formula, locale."""
    return (
        catalogs.withColumn("language", header_value("headers", "Language"))
        .withColumn("plural_forms", header_value("headers", "Plural-Forms"))
        .withColumn("target_language", target_language("language"))
        .withColumn("formula", target_formula("plural_forms"))
        .withColumn("locale", normalized_locale("target_language"))
    )


def lookup_plural_samples(catalogs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Left join of catalogs (with ``locale``) to the per-language sample table.

    The sample table has one row per known language (fixed size), so it is
    broadcast; unknown or empty locales get null samples.
    """
    spark = spark or catalogs.sparkSession
    dim = plural_sample_dim(spark).select(F.col("code").alias("locale"), "samples")
    return catalogs.join(F.broadcast(dim), on="locale", how="left")


def invalid_source_languages(requested: DataFrame, column: str = "source_lang") -> DataFrame:
    """Rows whose ``trim().toLowerCase()`` code is not an ISO 639-1 code (null: not either)."""
    return requested.where(~_is_language(column))


def valid_source_languages(requested: DataFrame, column: str = "source_lang") -> DataFrame:
    return requested.where(_is_language(column))


def _is_language(column: str) -> Column:
    return F.coalesce(F.lower(js_trim(column)).isin(ISO_639_1), F.lit(False))
