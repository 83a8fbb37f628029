"""Cut each catalog's work-list into requests of at most 15 consecutive items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.operators.numbering import dense_ordinal
from potable.operators.select import parser_key, with_parser_key
from potable.operators.spread import spread_join

# Fixed value: items per model request.
BATCH_SIZE = 15


def number_batches(work: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Add ``item_no`` (1-based, per catalog, in parser order), ``batch_no`` and ``pos``."""
    numbered = dense_ordinal(with_parser_key(work), ["catalog_id"], parser_key(), "item_no")
    return numbered.withColumn("batch_no", (F.floor((F.col("item_no") - 1) / size) + 1).cast("bigint")).withColumn(
        "pos", ((F.col("item_no") - 1) % size).cast("int")
    )


def _item() -> F.Column:
    """Request item: a plural carries ``msgid_plural`` and no ``msgid``;
    ``msgid_orig`` keeps the entry key for the merge."""
    return F.struct(
        F.col("pos"),
        F.col("seq"),
        F.col("msgctxt"),
        F.when(F.col("msgid_plural").isNull(), F.col("msgid")).alias("msgid"),
        F.col("msgid_plural"),
        F.col("msgid").alias("msgid_orig"),
    )


def batch_requests(numbered: DataFrame) -> DataFrame:
    """One row per (catalog, batch): the items array sorted by ``pos``.

    Groups hold at most ``BATCH_SIZE`` rows, so the shuffle on
    ``(catalog_id, batch_no)`` is balanced even for a giant catalog.
    """
    return numbered.groupBy("catalog_id", "batch_no").agg(
        F.array_sort(F.collect_list(_item())).alias("items"),
        F.count(F.lit(1)).alias("n_items"),
    )


def batch_summary(requests: DataFrame) -> DataFrame:
    """Batch k of n with item count, plus the progress line the CLI prints."""
    per_cat = requests.groupBy("catalog_id").agg(
        F.sum("n_items").alias("catalog_items"), F.max("batch_no").alias("max_batch")
    )
    s = spread_join(requests.select("catalog_id", "batch_no", "n_items"), per_cat, ["catalog_id"], by=["batch_no"])
    total = F.ceil(F.col("catalog_items") / F.lit(BATCH_SIZE)).cast("bigint")
    return s.select(
        "catalog_id",
        "batch_no",
        total.alias("total_batches"),
        F.col("n_items").cast("bigint").alias("n_items"),
        F.concat(
            F.lit("Translating batch "),
            F.col("batch_no").cast("string"),
            F.lit("/"),
            total.cast("string"),
            F.lit(" ("),
            F.col("n_items").cast("string"),
            F.when(F.col("n_items") == 1, F.lit(" phrase")).otherwise(F.lit(" phrases")),
            F.lit(")..."),
        ).alias("progress"),
    )
