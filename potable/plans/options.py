"""Job options: a job-level config plus per-catalog explicit overrides.

Explicit values beat config values per field; null means "not set", while
``false`` and ``0`` are values. Booleans default to false after the merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.plans.catalog import catalogs

FIELDS = {
    "source_lang": "string",
    "model": "string",
    "include_fuzzy": "boolean",
    "add_fuzzy": "boolean",
    "fold_length": "int",
    "context": "string",
    "debug": "boolean",
}
BOOLEAN_DEFAULT_FALSE = ("include_fuzzy", "add_fuzzy", "debug")

# Job-level config used by the registered queries (what a config file would hold).
JOB_CONFIG = {
    "source_lang": "en",
    "model": None,
    "include_fuzzy": False,
    "add_fuzzy": None,
    "fold_length": None,
    "context": "Product UI strings",
    "debug": False,
}


def catalog_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Explicit per-catalog settings, derived from the source number so the same
    table can be rebuilt by the SQL oracle."""
    c = catalogs(spark, sf).select("catalog_id", "source", "lang")
    n = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    nul = F.lit(None)
    return c.select(
        "catalog_id",
        F.when(n % 4 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
        .when(n % 4 == 1, F.lit("zz"))
        .when(n % 4 == 3, F.concat("lang", F.lit("-x")))
        .alias("source_lang"),
        F.when(n % 3 == 0, F.lit("gpt-4.1")).alias("model"),
        F.when(n % 5 == 0, F.lit(True)).when(n % 5 == 1, F.lit(False)).alias("include_fuzzy"),
        F.when(n % 2 == 0, F.lit(False)).when(n % 7 == 1, F.lit(True)).alias("add_fuzzy"),
        F.when(n % 6 == 0, F.lit(0)).when(n % 6 == 1, F.lit(76)).cast("int").alias("fold_length"),
        F.when(n % 7 == 0, F.lit("Use formal tone")).when(n % 7 == 1, F.lit("   ")).alias("context"),
        F.when(n % 8 == 0, F.lit(True)).otherwise(nul.cast("boolean")).alias("debug"),
    )


def resolve_options(overrides: DataFrame, config: dict | None = None) -> DataFrame:
    """Per catalog: ``coalesce(explicit, config, default)`` for every field."""
    cfg = JOB_CONFIG if config is None else config
    cols = ["catalog_id"]
    out = []
    for f, t in FIELDS.items():
        v = F.coalesce(F.col(f).cast(t), F.lit(cfg.get(f)).cast(t))
        if f in BOOLEAN_DEFAULT_FALSE:
            v = F.coalesce(v, F.lit(False))
        out.append(v.alias(f))
    return overrides.select(*cols, *out)
