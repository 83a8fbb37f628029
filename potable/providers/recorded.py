"""Replay of a recorded log.

A replay is ``(requests, attempt) -> attempts``: a row with ``attempt``, ``status``,
``code``, ``message`` and ``content`` for every request row. It costs no call, so
whole rounds are answered at once (live calls: ``live.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recorded_provider(log: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """Answer attempt k from a recorded attempt log (equi-join on the batch key).

    Batches without a recorded attempt k get status 599 (no reply recorded),
    which is not retryable, so the run stops there instead of inventing data.
    """

    def provider(requests: DataFrame, attempt: int) -> DataFrame:
        rec = log.where(F.col("attempt") == attempt).select("catalog_id", "batch_no", "status", "code", "message", "content")
        if attempt > 1:
            # few are asked again: the rest of the log needn't be shuffled to them
            rec = rec.join(requests.select("catalog_id", "batch_no"), on=["catalog_id", "batch_no"], how="left_semi")
        return (
            requests.join(rec, on=["catalog_id", "batch_no"], how="left")
            .withColumn("attempt", F.lit(attempt).cast("int"))
            .withColumn("status", F.coalesce(F.col("status"), F.lit(599)).cast("int"))
        )

    return provider
