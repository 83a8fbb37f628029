"""Registered queries for language fields, requests, the model stage and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.functions.text import placeholders
from potable.operators import attempts as att
from potable.operators import merge, report, validate
from potable.operators.locale import (
    invalid_source_languages,
    lookup_plural_samples,
    plural_sample_dim,
    samples_text,
)
from potable.operators.plural_formula import formula_samples, own_plural_samples
from potable.operators.request import PROJECT_SECTION_HEADER, system_message
from potable.plans.catalog import catalogs, entries, msgstr_text
from potable.plans.options import catalog_overrides, resolve_options
from potable.plans.queries import query
from potable.plans.translate import Options, translate, validated_attempts
from potable.sources.tables import read_table

# ------------------------------------------------------------------------- language


@query("po_headers")
def q_po_headers(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogs(spark, sf)
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return c.select("catalog_id", F.array_join(F.array_sort(pairs), "\u001f").alias("headers_text"))


@query("catalog_language")
def q_catalog_language(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs(spark, sf).select("catalog_id", "language")


@query("catalog_plural_forms")
def q_catalog_plural_forms(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs(spark, sf).select("catalog_id", "plural_forms")


@query("target_language")
def q_target_language(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs(spark, sf).select("catalog_id", "target_language", "formula")


@query("normalized_locale")
def q_normalized_locale(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs(spark, sf).select("catalog_id", "locale")


@query("lookup_plural_samples")
def q_lookup_plural_samples(spark: SparkSession, sf: str) -> DataFrame:
    c = lookup_plural_samples(catalogs(spark, sf))
    return c.select("catalog_id", "locale", samples_text("samples").alias("samples_text"))


def document_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """A ``Plural-Forms`` header per document, made from its number: usable ones of five shapes and faulty ones."""
    docs = read_table(spark, sf, "documents").select("doc_id").where("doc_id is not null")
    numbers = docs.selectExpr("doc_id", "doc_id % 9 + 2 as a", "doc_id % 13 + 1 as c").selectExpr("*", "doc_id % a as b")
    return numbers.selectExpr("doc_id", """case doc_id % 6
      when 0 then format_string('nplurals=2; plural=(n %% %d > %d);', a, b)
      when 1 then format_string('nplurals=3; plural=n%%%d==%d ? 0 : n>=%d && !(n%%%d) || n==0 ? 1 : 2;', a, b, c, c)
      when 2 then format_string('nplurals=4; plural=(n/%d+%d-n%%%d)%%4;', a, c, a)
      when 3 then format_string('nplurals=%d; plural=n%%%d;', doc_id div 6 % 4, a)
      when 4 then format_string(
        if(doc_id % 12 = 4, 'nplurals=2; plural=n!=%d && 100/(n-%d)>%d', 'nplurals=2; plural=n==%d || 100/(n-%d)<%d || 7%%(n-1)'), c, c, b)
      else if(doc_id % 9 = 2, null, format_string('nplurals=2; plural=n>%d', b) || if(doc_id % 9 = 5, ' +;', ';')) end as formula""")


@query("plural_formula_samples")
def q_plural_formula_samples(spark: SparkSession, sf: str) -> DataFrame:
    found = formula_samples(document_formulas(spark, sf), by=["doc_id"])
    text = F.transform("formula_samples", lambda s: F.concat_ws(":", s["plural"], F.coalesce(s["sample"].cast("string"), F.lit("-"))))
    return found.select(
        "doc_id", F.coalesce("formula_nplurals", F.lit(-1)).cast("bigint").alias("nplurals"), F.array_join(text, ",").alias("samples_text"),
        F.col("formula_fault").alias("fault"),
    )


@query("own_plural_samples")
def q_own_plural_samples(spark: SparkSession, sf: str) -> DataFrame:
    return own_plural_samples(catalogs(spark, sf)).select(
        "catalog_id", "locale", "samples_from", samples_text("samples").alias("samples_text")
    )


@query("plural_samples")
def q_plural_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples per language present in ``documents`` (derived from the rule)."""
    langs = catalogs(spark, sf).select(F.col("lang").alias("code")).distinct()
    dim = plural_sample_dim(spark)
    return langs.join(F.broadcast(dim), on="code", how="inner").select(
        F.col("code").alias("lang"), F.col("nplurals").cast("bigint").alias("nplurals"), samples_text("samples").alias("samples_text")
    )


@query("invalid_source_lang")
def q_invalid_source_lang(spark: SparkSession, sf: str) -> DataFrame:
    o = catalog_overrides(spark, sf).where(F.col("source_lang").isNotNull())
    return invalid_source_languages(o, "source_lang").select("catalog_id", "source_lang")


@query("resolve_options")
def q_resolve_options(spark: SparkSession, sf: str) -> DataFrame:
    r = resolve_options(catalog_overrides(spark, sf))
    return r.withColumn("fold_length", F.coalesce(F.col("fold_length").cast("bigint"), F.lit(-1)))


@query("system_message")
def q_system_message(spark: SparkSession, sf: str) -> DataFrame:
    o = resolve_options(catalog_overrides(spark, sf))
    msg = system_message(F.col("context"))
    return o.select(
        "catalog_id",
        msg.contains(PROJECT_SECTION_HEADER).alias("has_project_section"),
        msg.alias("message"),
    )


# ------------------------------------------------------------------------- requests


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return translate(spark, sf)["requests"]


@query("build_payload")
def q_build_payload(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("payload_json")
    return _requests(spark, sf).select(
        "catalog_id",
        "batch_no",
        F.array_join(F.json_object_keys(p), ",").alias("keys_text"),
        F.get_json_object(p, "$.formula").alias("formula"),
        F.get_json_object(p, "$.target_language").alias("target_language"),
        F.get_json_object(p, "$.source_language").alias("source_language"),
        F.json_array_length(F.get_json_object(p, "$.translations")).cast("bigint").alias("n_translations"),
        F.md5(p).alias("payload_md5"),
        F.coalesce(F.json_array_length(F.get_json_object(p, "$.plural_samples")), F.lit(0)).cast("bigint").alias("n_samples"),
    )


@query("request_params")
def q_request_params(spark: SparkSession, sf: str) -> DataFrame:
    rf = F.col("response_format")
    return _requests(spark, sf).select(
        "catalog_id",
        "batch_no",
        "model",
        F.col("temperature").cast("bigint").alias("temperature"),
        F.get_json_object(rf, "$.type").alias("response_type"),
        F.get_json_object(rf, "$.json_schema.name").alias("schema_name"),
        F.get_json_object(rf, "$.json_schema.strict").alias("strict"),
    )


# ------------------------------------------------------------------ replies to the run's attempts


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    run = translate(spark, sf)
    return validated_attempts(run["requests"], run["attempts"])


@query("strip_json_fences")
def q_strip_json_fences(spark: SparkSession, sf: str) -> DataFrame:
    m = translate(spark, sf)["attempts"].where(F.col("content").isNotNull())
    return m.select("catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), validate.strip_json_fences("content").alias("stripped"))


@query("validate_responses")
def q_validate_responses(spark: SparkSession, sf: str) -> DataFrame:
    m = translate(spark, sf)["attempts"]
    return m.select(
        "catalog_id",
        "batch_no",
        F.col("attempt").cast("bigint").alias("attempt"),
        "error_code",
        F.coalesce(F.col("error_pos"), F.lit(-1)).cast("bigint").alias("error_pos"),
        "retryable",
    )


@query("normalize_msgctxt")
def q_normalize_msgctxt(spark: SparkSession, sf: str) -> DataFrame:
    m = _parsed(spark, sf).where(F.col("parsed").isNotNull())
    return m.select("catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), F.posexplode("parsed").alias("pos", "x")).select(
        "catalog_id",
        "batch_no",
        F.col("attempt").cast("bigint").alias("attempt"),
        F.col("pos").cast("bigint").alias("pos"),
        validate.normalize_msgctxt(F.variant_get("x", "$.msgctxt", "variant")).alias("msgctxt_norm"),
    )


@query("coerce_result")
def q_coerce_result(spark: SparkSession, sf: str) -> DataFrame:
    r = validate.align_response(_parsed(spark, sf))
    return r.select(
        "catalog_id",
        "batch_no",
        F.col("attempt").cast("bigint").alias("attempt"),
        F.col("pos").cast("bigint").alias("pos"),
        msgstr_text().alias("msgstr_text"),
        F.size("msgstr").cast("bigint").alias("n_forms"),
    )


@query("classify_api_error")
def q_classify_api_error(spark: SparkSession, sf: str) -> DataFrame:
    m = translate(spark, sf)["attempts"].where(F.col("status") != 200)
    return m.select("catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), F.col("status").cast("bigint").alias("status"),
                    att.classify_api_error().alias("category"))


@query("is_retryable")
def q_is_retryable(spark: SparkSession, sf: str) -> DataFrame:
    m = translate(spark, sf)["attempts"]
    return m.select("catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), att.is_retryable("status", "error_code").alias("retryable"))


# ------------------------------------------------------------------- the actual run


@query("retry_rounds")
def q_retry_rounds(spark: SparkSession, sf: str) -> DataFrame:
    log = translate(spark, sf)["attempts"]
    return log.select("catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), F.col("status").cast("bigint").alias("status"))


@query("translate_batches")
def q_translate_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The replies of the run, attempt by attempt, as the service log holds them."""
    return translate(spark, sf)["attempts"].select(
        "catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), F.col("status").cast("bigint").alias("status"), "code", "message",
        F.md5("content").alias("content_md5"),
    )


@query("backoff_ms")
def q_backoff_ms(spark: SparkSession, sf: str) -> DataFrame:
    """Wait applied before each retry that was actually sent."""
    log = translate(spark, sf)["attempts"].where(F.col("attempt") > 1)
    return log.select("catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), att.backoff_ms(F.col("attempt") - 1).cast("bigint").alias("backoff_ms"))


@query("resolve_attempts")
def q_resolve_attempts(spark: SparkSession, sf: str) -> DataFrame:
    v = translate(spark, sf)["validated"]
    r = att.resolve_attempts(v)
    return r.select(
        "catalog_id", "batch_no", "n_attempts", F.col("final_attempt").cast("bigint").alias("final_attempt"),
        "final_code", "n_invalid", "outcome",
    )


@query("committed_prefix")
def q_committed_prefix(spark: SparkSession, sf: str) -> DataFrame:
    o = translate(spark, sf)["outcomes"]
    return o.select("catalog_id", "batch_no", "outcome", "committed")


@query("align_response")
def q_align_response(spark: SparkSession, sf: str) -> DataFrame:
    r = translate(spark, sf)["results"]
    return r.select(
        "catalog_id", "batch_no", F.col("pos").cast("bigint").alias("pos"), "seq", "msgctxt", "msgid", "msgid_plural",
        msgstr_text().alias("msgstr_text"),
    )


@query("translate_entries")
def q_translate_entries(spark: SparkSession, sf: str) -> DataFrame:
    r = translate(spark, sf)["results"]
    return r.select("catalog_id", "seq", "msgid", msgstr_text().alias("msgstr_text"))


@query("report_lines")
def q_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    r = report.report_lines(translate(spark, sf)["results"])
    return r.select("catalog_id", "batch_no", F.col("pos").cast("bigint").alias("pos"), "line")


@query("placeholder_parity")
def q_placeholder_parity(spark: SparkSession, sf: str) -> DataFrame:
    r = translate(spark, sf)["results"]
    src = placeholders(F.coalesce("msgid_plural", "msgid"))
    ok = F.forall("msgstr", lambda f: placeholders(f) == src)
    return r.select("catalog_id", "seq", F.array_join(src, " ").alias("source_placeholders"), ok.alias("parity_ok"))


# ------------------------------------------------------------------------------ merge


@query("apply_translations")
def q_apply_translations(spark: SparkSession, sf: str) -> DataFrame:
    m = translate(spark, sf)["merged"]
    return m.select("catalog_id", "seq", "msgctxt", "msgid", msgstr_text().alias("msgstr_text"), "translated_now")


@query("merge_batches")
def q_merge_batches(spark: SparkSession, sf: str) -> DataFrame:
    m = translate(spark, sf)["merged"]
    return m.select("catalog_id", "seq", msgstr_text().alias("msgstr_text"), "flag", "translator")


@query("mark_machine_translated")
def q_mark_machine_translated(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.select("catalog_id", "seq", merge.mark_machine_translated(F.col("translator")).alias("translator"))


@query("add_fuzzy")
def q_add_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.select("catalog_id", "seq", merge.add_fuzzy(F.col("flag")).alias("flag"))


@query("clear_fuzzy")
def q_clear_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.select("catalog_id", "seq", merge.clear_fuzzy(F.col("flag")).alias("flag"))


@query("translate_catalog_options")
def q_translate_catalog_options(spark: SparkSession, sf: str) -> DataFrame:
    """Whole job with per-catalog options (explicit beats config): work-list with
    each catalog's include_fuzzy, invalid source languages rejected, flags
    cleared/added per catalog in the merge."""
    m = translate(spark, sf, Options(per_catalog=True))["merged"]
    return m.select("catalog_id", "seq", msgstr_text().alias("msgstr_text"), "flag", "translator")


@query("api_error_summary")
def q_api_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Failed calls of the run per error category (what the CLI would report)."""
    log = translate(spark, sf)["attempts"].where(F.col("status") != 200)
    per = log.groupBy(att.classify_api_error().alias("category")).agg(F.count(F.lit(1)).alias("n_attempts"))
    return per.withColumn("advice", att.advice("category", None))


@query("flagship")
def q_flagship(spark: SparkSession, sf: str) -> DataFrame:
    from potable.plans.flagship import flagship

    return flagship(spark, sf)
