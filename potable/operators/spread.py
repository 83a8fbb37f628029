"""Joins of many rows with one row per key, without a hot key.

A catalog may hold a third of all entries, so a plain shuffle of entries or
requests on ``catalog_id`` would put it into one task. The small side is repeated
over ``SALTS`` values and each row of the large side takes one of them by a hash
of its own columns, so a key's rows are dealt over that many join keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (at most one row per ``keys``) on ``keys``."""
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    return own.join(salted, on=[*keys, "__salt"], how=how).drop("__salt")
