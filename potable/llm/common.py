"""Small shared pieces: reading tables, own column names, written tables, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators.numbering import materialize
from potable.session import run_folder
from potable.sources.tables import read_table

#: the ASCII white space that separates words, and a word
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once in the shared checkpoint folder and read back (cuts lineage)."""
    return materialize(df, f"llm-{label}")


_SHIPPED: set[str] = set()
#: characters of a plan's description, and what Spark sets where nobody did
PLAN_TEXT, NO_LIMIT = 20_000, "2147483632"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would.

    Whole texts make wide rows, so an unchanged Arrow batch size is lowered. The driver
    keeps a description of every plan it re-plans; without a limit of its own, they are cut.
    """
    if spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b") == NO_LIMIT:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="potable-py-"), "potable_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    return run_folder(spark, f"llm-{label}-{uuid.uuid4().hex}")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` alone would also change accented letters)."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


def total_text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one column-pruned aggregate); sizes groups, never results."""
    row = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["b"] or 0)
