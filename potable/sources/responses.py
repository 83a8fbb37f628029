"""Model replies as a table.

Live providers log the raw HTTP bodies (chat-completions shape); the scan reads
them back and takes ``choices[0].message.content`` with a JSON path, the same
field the reference reads, so validation can be re-run from the log alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators.numbering import short_shuffles

KEYS = ["catalog_id", "batch_no", "attempt", "status", "code", "message"]


def write_response_log(attempts: DataFrame, out_dir: str) -> None:
    """Attempt log -> JSON lines, compressed: keys plus the provider body (``choices`` shape)."""
    body = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content")).alias("message"))).alias("choices")
        ),
        {"ignoreNullFields": "false"},
    )
    with short_shuffles(attempts.sparkSession):
        attempts.select(*KEYS, body.alias("body")).write.mode("overwrite").option("compression", "gzip").json(out_dir)


def response_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """keys + ``content`` extracted from each logged body."""
    schema = "catalog_id string, batch_no bigint, attempt int, status int, code string, message string, body string"
    raw = spark.read.schema(schema).json(path)
    return raw.withColumn("content", F.get_json_object("body", "$.choices[0].message.content"))
