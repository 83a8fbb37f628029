"""Entry selection: status columns, work-lists, keys, order, dry run.

Status columns are materialised once (``with_status``) so later filters are
plain boolean predicates; higher-order functions never reach a parquet scan as
pushed filters, so persisting them as columns keeps pushdown possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.functions.text import integer_key_value, is_fuzzy, is_untranslated
from potable.operators.numbering import dense_ordinal
from potable.operators.spread import spread_join

KEY = ["catalog_id", "msgctxt", "msgid"]


def skip_header(entries: DataFrame) -> DataFrame:
    """Drop the header entry (``msgid ''``) in any context."""
    return entries.where(F.col("msgid") != F.lit(""))


def with_status(entries: DataFrame) -> DataFrame:
    """Add ``untranslated`` and ``fuzzy`` boolean columns."""
    return entries.withColumn("untranslated", is_untranslated("msgstr")).withColumn("fuzzy", is_fuzzy("flag"))


def untranslated_msgids(entries: DataFrame) -> DataFrame:
    """msgids of untranslated entries in parser order (fuzzy ignored, duplicates across contexts kept)."""
    blank = skip_header(entries).where(is_untranslated("msgstr"))
    return listed(blank).select("catalog_id", "order_no", "seq", "msgctxt", "msgid")


def worklist(entries: DataFrame, include_fuzzy: bool | str = False) -> DataFrame:
    """Entries to send: untranslated, plus fuzzy-with-text when ``include_fuzzy``.

    ``include_fuzzy`` may also name a boolean column (per-catalog option).
    Fuzzy-and-blank entries are untranslated and therefore always selected.
    Adds the request shape: ``req_msgstr`` (plural: copy of ``msgstr``, or
    ``[]`` for fuzzy-with-text; singular: ``[]`` for fuzzy-with-text, else null).
    """
    s = with_status(skip_header(entries))
    opt = F.col(include_fuzzy) if isinstance(include_fuzzy, str) else F.lit(bool(include_fuzzy))
    picked = s.where(F.col("untranslated") | (opt & F.col("fuzzy")))
    stale = F.col("fuzzy") & ~F.col("untranslated")
    empty = F.array().cast("array<string>")
    return picked.withColumn(
        "req_msgstr",
        F.when(F.col("msgid_plural").isNotNull(), F.when(stale, empty).otherwise(F.col("msgstr"))).otherwise(
            F.when(stale, empty)
        ),
    )


def entry_keys(work: DataFrame) -> DataFrame:
    """``{context, msgid}`` of selected entries, in parser order."""
    return listed(work).select("catalog_id", "order_no", "seq", F.col("msgctxt").alias("context"), "msgid")


def request_item(work: DataFrame) -> DataFrame:
    """Model-facing item: plural -> ``msgid_plural`` only, singular -> ``msgid``; context always set."""
    return work.withColumn(
        "item",
        F.struct(
            F.when(F.col("msgid_plural").isNull(), F.col("msgid")).alias("msgid"),
            F.col("msgid_plural").alias("msgid_plural"),
            F.col("msgctxt").alias("msgctxt"),
        ),
    )


def nothing_to_do(catalogs: DataFrame, work: DataFrame) -> DataFrame:
    """Catalogs with an empty work-list (no model call)."""
    return catalogs.join(work.select("catalog_id").distinct(), on="catalog_id", how="left_anti")


def with_parser_key(entries: DataFrame) -> DataFrame:
    """Add ``ctx_first``: where the entry's context is first seen in its catalog (unless it is there)."""
    if "ctx_first" in entries.columns:
        return entries
    first = entries.groupBy("catalog_id", "msgctxt").agg(F.min("seq").alias("ctx_first"))
    return spread_join(entries, first, ["catalog_id", "msgctxt"], by=["seq"])


def parser_key() -> list[Column]:
    """Sort columns of the parser's iteration order inside a catalog.

    Contexts in first-seen order, msgids in file order inside a context; keys
    that are JS array indices (``"7"``) come first, ascending — for contexts and
    for msgids.
    """
    context, msgid = integer_key_value("msgctxt"), integer_key_value("msgid")
    return [context.isNull(), context, F.col("ctx_first"), msgid.isNull(), msgid, F.col("seq")]


def listed(entries: DataFrame) -> DataFrame:
    """Add ``order_no``: position in parser order among these entries of the catalog."""
    return dense_ordinal(with_parser_key(entries), ["catalog_id"], parser_key(), "order_no")


def parser_order(entries: DataFrame) -> DataFrame:
    """Position of each entry in the parser's iteration order (``order_no``)."""
    return listed(entries)


def dry_run(work: DataFrame) -> DataFrame:
    """The listing a dry run prints: msgids in parser order (no call, no write)."""
    return listed(work).select("catalog_id", "order_no", "seq", "msgid")
