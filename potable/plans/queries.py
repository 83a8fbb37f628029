"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (through the entries/catalogs tables
derived from ``documents``) and returns scalar columns only, aliased to the
names the DuckDB oracle uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.functions.text import is_fuzzy, is_untranslated, js_trim
from potable.operators import batching, report
from potable.operators import select as sel
from potable.plans.catalog import entries, msgstr_text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# ----------------------------------------------------------------- entries & predicates


@query("dedupe_keys")
def q_dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(
        "catalog_id",
        "seq",
        "msgctxt",
        "msgid",
        "msgid_plural",
        "flag",
        "translator",
        msgstr_text().alias("msgstr_text"),
        F.coalesce(F.size("msgstr"), F.lit(-1)).cast("bigint").alias("n_forms"),
    )


@query("skip_header")
def q_skip_header(spark: SparkSession, sf: str) -> DataFrame:
    return sel.skip_header(entries(spark, sf)).select("catalog_id", "seq", "msgctxt", "msgid")


@query("is_untranslated")
def q_is_untranslated(spark: SparkSession, sf: str) -> DataFrame:
    return sel.skip_header(entries(spark, sf)).select(
        "catalog_id", "seq", is_untranslated("msgstr").alias("untranslated")
    )


@query("is_fuzzy")
def q_is_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return sel.skip_header(entries(spark, sf)).select("catalog_id", "seq", is_fuzzy("flag").alias("fuzzy"))


@query("js_trim")
def q_js_trim(spark: SparkSession, sf: str) -> DataFrame:
    """JS trim of every msgstr form and of every flag token."""
    e = entries(spark, sf)
    forms = e.select("catalog_id", "seq", F.posexplode("msgstr").alias("k", "s")).select(
        "catalog_id",
        "seq",
        F.lit("msgstr").alias("field"),
        F.col("k").cast("bigint").alias("k"),
        js_trim("s").alias("trimmed"),
    )
    flags = e.where(F.col("flag").isNotNull()).select(
        "catalog_id", "seq", F.posexplode(F.split("flag", ",")).alias("k", "s")
    ).select(
        "catalog_id",
        "seq",
        F.lit("flag").alias("field"),
        F.col("k").cast("bigint").alias("k"),
        js_trim("s").alias("trimmed"),
    )
    return forms.unionByName(flags)


@query("untranslated_msgids")
def q_untranslated_msgids(spark: SparkSession, sf: str) -> DataFrame:
    return sel.untranslated_msgids(entries(spark, sf))


def _work_cols(w: DataFrame) -> DataFrame:
    return w.select(
        "catalog_id",
        "seq",
        "msgctxt",
        "msgid",
        "msgid_plural",
        F.coalesce(F.size("req_msgstr"), F.lit(-1)).cast("bigint").alias("req_n"),
        msgstr_text("req_msgstr").alias("req_text"),
    )


@query("worklist")
def q_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return _work_cols(sel.worklist(entries(spark, sf)))


@query("worklist_include_fuzzy")
def q_worklist_include_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _work_cols(sel.worklist(entries(spark, sf), include_fuzzy=True))


@query("request_shape")
def q_request_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of included-fuzzy requests: stale fuzzy text is replaced by ``[]``."""
    w = sel.worklist(entries(spark, sf), include_fuzzy=True)
    return w.select(
        "catalog_id",
        "seq",
        F.col("msgid_plural").isNotNull().alias("is_plural"),
        F.col("req_msgstr").isNotNull().alias("has_msgstr"),
        F.coalesce(F.size("req_msgstr"), F.lit(-1)).cast("bigint").alias("req_n"),
    )


@query("entry_keys")
def q_entry_keys(spark: SparkSession, sf: str) -> DataFrame:
    return sel.entry_keys(sel.worklist(entries(spark, sf)))


@query("request_item")
def q_request_item(spark: SparkSession, sf: str) -> DataFrame:
    w = sel.request_item(sel.worklist(entries(spark, sf)))
    return w.select(
        "catalog_id",
        "seq",
        F.col("item.msgid").alias("item_msgid"),
        F.col("item.msgid_plural").alias("item_msgid_plural"),
        F.col("item.msgctxt").alias("item_msgctxt"),
    )


@query("nothing_to_do")
def q_nothing_to_do(spark: SparkSession, sf: str) -> DataFrame:
    from potable.plans.catalog import catalogs

    cats = catalogs(spark, sf).select("catalog_id")
    return sel.nothing_to_do(cats, sel.worklist(entries(spark, sf))).select("catalog_id")


@query("parser_order")
def q_parser_order(spark: SparkSession, sf: str) -> DataFrame:
    return sel.parser_order(sel.skip_header(entries(spark, sf))).select("catalog_id", "seq", "order_no")


@query("dry_run")
def q_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return sel.dry_run(sel.worklist(entries(spark, sf)))


@query("dry_run_include_fuzzy")
def q_dry_run_include_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return sel.dry_run(sel.worklist(entries(spark, sf), include_fuzzy=True))


# ----------------------------------------------------------------------------- batching


def numbered_worklist(spark: SparkSession, sf: str, include_fuzzy: bool = False) -> DataFrame:
    return batching.number_batches(sel.worklist(entries(spark, sf), include_fuzzy=include_fuzzy))


@query("batch_number")
def q_batch_number(spark: SparkSession, sf: str) -> DataFrame:
    n = numbered_worklist(spark, sf)
    return n.select("catalog_id", "seq", "item_no", "batch_no", F.col("pos").cast("bigint").alias("pos"))


def _requests_text(r: DataFrame) -> DataFrame:
    return r.select(
        "catalog_id",
        "batch_no",
        F.col("n_items").cast("bigint").alias("n_items"),
        F.col("items")[0]["seq"].alias("first_seq"),
        F.element_at("items", -1)["seq"].alias("last_seq"),
        F.array_join(
            F.transform("items", lambda x: F.coalesce(x["msgid_plural"], x["msgid"])), "\u001f"
        ).alias("items_text"),
    )


@query("batch_requests")
def q_batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _requests_text(batching.batch_requests(numbered_worklist(spark, sf)))


@query("batch_summary")
def q_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return batching.batch_summary(batching.batch_requests(numbered_worklist(spark, sf)))


# ------------------------------------------------------------------------------ reports


@query("catalog_coverage")
def q_catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return report.catalog_coverage(entries(spark, sf))
