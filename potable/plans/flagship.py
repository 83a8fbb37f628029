"""Flagship query: per-catalog coverage before and after one translation run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators.report import catalog_coverage
from potable.plans.catalog import entries
from potable.plans.translate import Options, translate


def flagship(spark: SparkSession, sf: str, opts: Options = Options()) -> DataFrame:
    """documents -> entries -> work-list -> requests -> provider -> validation ->
    commit prefix -> merge -> coverage before/after, per catalog."""
    run = translate(spark, sf, opts)
    before = catalog_coverage(entries(spark, sf), include_fuzzy=opts.include_fuzzy)
    after = catalog_coverage(run["merged"], include_fuzzy=opts.include_fuzzy)
    batches = run["outcomes"].groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.count_if("committed").alias("n_committed"),
        F.count_if(F.col("outcome") == "failed").alias("n_failed"),
    )
    return (
        before.select(
            "catalog_id",
            "n_entries",
            F.col("n_untranslated").alias("untranslated_before"),
            F.col("n_machine").alias("machine_before"),
        )
        .join(
            after.select(
                "catalog_id",
                F.col("n_untranslated").alias("untranslated_after"),
                F.col("n_machine").alias("machine_after"),
            ),
            on="catalog_id",
            how="inner",
        )
        .join(batches, on="catalog_id", how="left")
        .select(
            "catalog_id",
            "n_entries",
            "untranslated_before",
            "untranslated_after",
            "machine_before",
            "machine_after",
            F.coalesce("n_batches", F.lit(0)).alias("n_batches"),
            F.coalesce("n_committed", F.lit(0)).alias("n_committed"),
            F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        )
    )
