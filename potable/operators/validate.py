"""Response validation: the reply contract checked row by row on VARIANT data.

One attempt row carries its request's items (sorted by ``pos``) and the raw
reply ``content``. The reply is parsed to VARIANT once; document-level rules
are a CASE, entry-level rules run in a ``transform`` over the items zipped
with the reply array by position, and the first failing position wins. No
join and no explode: validation is a projection.

Codes, in precedence order: EMPTY, NOT_JSON, NO_TRANSLATIONS,
TRANSLATIONS_NOT_ARRAY, COUNT_MISMATCH; then per entry MISSING_MSGSTR,
CTX_MISMATCH, (singular) ID_MISMATCH, UNEXPECTED_PLURAL, MSGSTR_NOT_STRING,
(plural) PLURAL_MISMATCH, UNEXPECTED_MSGID, MSGSTR_NOT_STRING_ARRAY,
PLURAL_LENGTH. CTX/ID/PLURAL mismatches are retryable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.functions.text import JS_WS_CLASS, is_blank, js_trim

RETRYABLE_CODES = ("CTX_MISMATCH", "ID_MISMATCH", "PLURAL_MISMATCH")
RETRYABLE_STATUS = (429, 500, 503)

_FENCE = f"(?s)\\A```(?:json)?{JS_WS_CLASS}*\\n?(.*?)\\n?```{JS_WS_CLASS}*\\z"


def strip_json_fences(content: Column | str) -> Column:
    """Trim; when the whole text is a ``` or ```json block, its body trimmed."""
    c = F.col(content) if isinstance(content, str) else content
    raw = js_trim(c)
    return F.when(raw.rlike(_FENCE), js_trim(F.regexp_extract(raw, _FENCE, 1))).otherwise(raw)


#: stands behind the reply while it is parsed; Spark's parser would ignore text behind the first value
_END = "end of reply"


def reply_document(content: Column | str) -> Column:
    """The reply as VARIANT; null unless its whole text is one JSON value."""
    whole = F.try_parse_json(F.concat(F.lit("["), strip_json_fences(content), F.lit(f',"{_END}"]')))
    parts = F.try_variant_get(whole, "$", "array<variant>")
    closed = (F.size(parts) == 2) & (F.try_variant_get(whole, "$[1]", "string") == F.lit(_END))
    return F.when(closed, F.variant_get(whole, "$[0]", "variant"))


def _get(v: Column, key: str) -> Column:
    return F.variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_string(v: Column) -> Column:
    return F.coalesce(_kind(v) == F.lit("STRING"), F.lit(False))


def _str(v: Column) -> Column:
    return F.variant_get(v, "$", "string")


def normalize_msgctxt(v: Column) -> Column:
    """Reply context: a JSON string as is, anything else (absent, null, number) ``''``."""
    return F.when(_is_string(v), _str(v)).otherwise(F.lit(""))


def _has(x: Column, key: str) -> Column:
    # a present key gives a (possibly JSON-null) variant, an absent one SQL NULL
    return _get(x, key).isNotNull()


def _entry_code(it: Column, x: Column, n_samples: Column) -> Column:
    is_obj = F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))
    msgstr = _get(x, "msgstr")
    singular_req = it["msgid"].isNotNull()
    id_ok = _is_string(_get(x, "msgid")) & (F.coalesce(_str(_get(x, "msgid")), F.lit("")) == it["msgid"])
    pl_ok = _is_string(_get(x, "msgid_plural")) & (
        F.coalesce(_str(_get(x, "msgid_plural")), F.lit("")) == it["msgid_plural"]
    )
    arr = F.try_variant_get(msgstr, "$", "array<variant>")
    str_array = F.coalesce(_kind(msgstr).startswith("ARRAY"), F.lit(False)) & F.coalesce(
        F.forall(arr, lambda e: F.coalesce(_kind(e) == F.lit("STRING"), F.lit(False))), F.lit(False)
    )
    singular = (
        F.when(~id_ok, F.lit("ID_MISMATCH"))
        .when(_has(x, "msgid_plural"), F.lit("UNEXPECTED_PLURAL"))
        .when(~_is_string(msgstr), F.lit("MSGSTR_NOT_STRING"))
    )
    plural = (
        F.when(~pl_ok, F.lit("PLURAL_MISMATCH"))
        .when(_has(x, "msgid"), F.lit("UNEXPECTED_MSGID"))
        .when(~str_array, F.lit("MSGSTR_NOT_STRING_ARRAY"))
        .when((n_samples > 0) & (F.size(arr) != n_samples), F.lit("PLURAL_LENGTH"))
    )
    return (
        F.when(~is_obj | ~_has(x, "msgstr"), F.lit("MISSING_MSGSTR"))
        .when(normalize_msgctxt(_get(x, "msgctxt")) != F.coalesce(it["msgctxt"], F.lit("")), F.lit("CTX_MISMATCH"))
        .when(singular_req, singular)
        .otherwise(plural)
    )


def validate(attempts: DataFrame, samples: str = "samples") -> DataFrame:
    """Add ``parsed`` (VARIANT reply array), ``error_code``, ``error_pos`` and ``retryable``.

    Input columns: ``items`` (request items sorted by pos), ``n_items``,
    ``samples`` (plural samples or null), ``status``, ``content``.
    API errors (status other than 200) get code ``API_ERROR``; their retry class
    comes from the status.

    The reply is parsed once into a column; the entry rules then run on the
    items zipped with the reply array, so every rule reads lambda variables
    only and no parse is ever repeated per entry.
    """
    api_error = F.col("status").isNotNull() & (F.col("status") != 200)
    staged = (
        attempts.withColumn("__v", reply_document("content"))
        .withColumn("__tr", _get(F.col("__v"), "translations"))
        .withColumn("__arr", F.try_variant_get(F.col("__tr"), "$", "array<variant>"))
        .withColumn("__ns", F.coalesce(F.size(F.col(samples)), F.lit(0)))
    )
    v, tr, arr = F.col("__v"), F.col("__tr"), F.col("__arr")
    doc = (
        F.when(api_error, F.lit("API_ERROR"))
        .when(is_blank(F.col("content")), F.lit("EMPTY"))
        .when(v.isNull(), F.lit("NOT_JSON"))
        .when(~F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)) | tr.isNull(), F.lit("NO_TRANSLATIONS"))
        .when(~F.coalesce(_kind(tr).startswith("ARRAY"), F.lit(False)), F.lit("TRANSLATIONS_NOT_ARRAY"))
        .when(F.size(arr) != F.col("n_items"), F.lit("COUNT_MISMATCH"))
    )
    with_doc = staged.withColumn("__doc", doc).withColumn("parsed", F.when(F.col("__doc").isNull(), arr))
    zipped = F.arrays_zip(F.col("items").alias("it"), F.col("parsed").alias("x"))
    codes = F.transform(
        zipped,
        lambda z, i: F.struct(_entry_code(z["it"], z["x"], F.col("__ns")).alias("c"), i.alias("i")),
    )
    first = F.try_element_at(F.filter(codes, lambda s: s["c"].isNotNull()), F.lit(1))
    return (
        with_doc.withColumn("__first", F.when(F.col("__doc").isNull(), first))
        .withColumn("error_code", F.coalesce(F.col("__doc"), F.col("__first.c"), F.lit("OK")))
        .withColumn("error_pos", F.col("__first.i").cast("int"))
        .withColumn(
            "retryable",
            F.when(api_error, F.col("status").isin(*RETRYABLE_STATUS)).otherwise(
                F.col("error_code").isin(*RETRYABLE_CODES)
            ),
        )
        .drop("__v", "__tr", "__arr", "__ns", "__doc", "__first")
    )


def parse_replies(attempts: DataFrame) -> DataFrame:
    """Accepted attempts only: add ``parsed`` (the reply array) without re-running
    the rule ladder; the verdict columns already say the reply passed."""
    v = reply_document("content")
    return attempts.withColumn("parsed", F.try_variant_get(_get(v, "translations"), "$", "array<variant>"))


def coerce_result(msgstr: Column, plural: Column) -> Column:
    """Validated reply value -> ``array<string>``: plural string -> [s], null -> [];
    singular array -> first element or ''."""
    kind = _kind(msgstr)
    as_arr = F.transform(F.try_variant_get(msgstr, "$", "array<variant>"), lambda e: _str(e))
    first = F.coalesce(F.try_element_at(as_arr, F.lit(1)), F.lit(""))
    return F.when(
        plural,
        F.when(kind == F.lit("STRING"), F.array(_str(msgstr)))
        .when(kind.startswith("ARRAY"), as_arr)
        .otherwise(F.array().cast("array<string>")),
    ).otherwise(
        F.array(F.when(kind == F.lit("STRING"), _str(msgstr)).when(kind.startswith("ARRAY"), first).otherwise(F.lit("")))
    )


def align_response(validated: DataFrame) -> DataFrame:
    """Accepted replies -> one result row per item, matched by position.

    The reply never carries a row key for plural items, so items and reply
    elements are paired by index inside the row, then exploded.
    """
    ok = validated.where(F.col("error_code") == F.lit("OK"))
    pairs = F.transform(
        F.arrays_zip(F.col("items").alias("it"), F.col("parsed").alias("x")),
        lambda z: F.struct(
            z["it"]["pos"].alias("pos"),
            z["it"]["seq"].alias("seq"),
            F.coalesce(z["it"]["msgctxt"], F.lit("")).alias("msgctxt"),
            z["it"]["msgid_orig"].alias("msgid"),
            z["it"]["msgid_plural"].alias("msgid_plural"),
            coerce_result(_get(z["x"], "msgstr"), z["it"]["msgid_plural"].isNotNull()).alias("msgstr"),
        ),
    )
    keep = [c for c in ("catalog_id", "batch_no", "attempt") if c in validated.columns]
    return ok.select(*keep, F.explode(pairs).alias("r")).select(*keep, "r.*")
