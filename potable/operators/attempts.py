"""Attempt log operators: error classes, retry rules, per-batch outcome, commit prefix.

The attempt log is append-only: one row per (catalog_id, batch_no, attempt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potable.operators.spread import spread_join

MAX_ATTEMPTS = 4
# Wait before attempt 2, 3, 4 (milliseconds).
RETRY_DELAYS_MS = [1000, 2000, 4000]


def classify_api_error(status: Column | str = "status", code: Column | str = "code", message: Column | str = "message") -> Column:
    """Status/code/message -> error category (null for non-API rows)."""

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    st, cd, msg = c(status), c(code), F.coalesce(c(message), F.lit(""))
    return (
        F.when(st.isNull() | (st == 200), F.lit(None).cast("string"))
        .when(st == 401, F.lit("invalid_api_key"))
        .when(st == 403, F.lit("region_unsupported"))
        .when(
            st == 429,
            F.when((F.coalesce(cd, F.lit("")) == "insufficient_quota") | msg.rlike("(?i)quota"), F.lit("quota_exceeded")).otherwise(
                F.lit("rate_limited")
            ),
        )
        .when(
            st == 400,
            F.when(msg.rlike("(?i)response_format|json_schema|structured"), F.lit("schema_unsupported")).otherwise(
                F.lit("invalid_request")
            ),
        )
        .when(st == 500, F.lit("server_error"))
        .when(st == 503, F.lit("overloaded"))
        .otherwise(F.lit("generic"))
    )


# Own wording of the advice shown per category.
CATEGORY_ADVICE = {
    "invalid_api_key": "The API key is missing or invalid; configure a valid key for the provider.",
    "region_unsupported": "The provider does not serve this country or region.",
    "quota_exceeded": "The account is out of credits or over its usage limit; check plan and billing.",
    "rate_limited": "Rate limit reached; the request was retried. Slow down if this persists.",
    "schema_unsupported": "The model may not support strict json_schema structured output; choose a compatible model.",
    "invalid_request": "The provider rejected the request as invalid.",
    "server_error": "The provider had a server error; retry later.",
    "overloaded": "The provider is overloaded; retry after a short wait.",
}


def advice(category: Column | str = "category", message: Column | str | None = "message") -> Column:
    """User-facing text per category; the two 400 classes append the provider
    message when one is given. ``generic`` has no advice (null)."""
    cat = F.col(category) if isinstance(category, str) else category
    out = F.lit(None).cast("string")
    for k, v in CATEGORY_ADVICE.items():
        text = F.lit(v)
        if message is not None and k in ("schema_unsupported", "invalid_request"):
            msg = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
            text = F.concat(F.lit(v + " Provider message: "), msg)
        out = F.when(cat == k, text).otherwise(out)
    return out


def is_retryable(status: Column | str = "status", error_code: Column | str = "error_code") -> Column:
    """429/500/503 (quota 429 included) or a protected-field mismatch; nothing else."""
    st = F.col(status) if isinstance(status, str) else status
    ec = F.col(error_code) if isinstance(error_code, str) else error_code
    return F.coalesce(st.isin(429, 500, 503), F.lit(False)) | F.coalesce(
        ec.isin("CTX_MISMATCH", "ID_MISMATCH", "PLURAL_MISMATCH"), F.lit(False)
    )


def backoff_ms(attempt: Column | str = "attempt") -> Column:
    """Wait after a failed attempt k before attempt k+1 (null after the last)."""
    a = F.col(attempt) if isinstance(attempt, str) else attempt
    return F.try_element_at(F.array(*[F.lit(x) for x in RETRY_DELAYS_MS]), a.cast("int"))


def is_terminal(error_code: str = "error_code", retryable: str = "retryable", attempt: str = "attempt") -> Column:
    return (F.col(error_code) == "OK") | ~F.col(retryable) | (F.col(attempt) >= MAX_ATTEMPTS)


def resolve_attempts(validated: DataFrame) -> DataFrame:
    """Per batch: final attempt (first success, first non-retryable failure, or
    attempt 4), outcome, and attempts recorded after the final one (invalid).

    The window is per batch (at most a handful of rows), never per catalog.
    """
    w = Window.partitionBy("catalog_id", "batch_no").orderBy("attempt")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = validated.withColumn("__term", is_terminal()).withColumn(
        "__term_before", F.coalesce(F.sum(F.col("__term").cast("int")).over(before), F.lit(0))
    )
    final = F.col("__term") & (F.col("__term_before") == 0)
    return marked.groupBy("catalog_id", "batch_no").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.max(F.when(final, F.col("attempt"))).alias("final_attempt"),
        F.max(F.when(final, F.col("error_code"))).alias("final_code"),
        F.count_if(F.col("__term_before") > 0).alias("n_invalid"),
    ).withColumn(
        "outcome",
        F.when(F.col("final_attempt").isNull(), F.lit("pending"))
        .when(F.col("final_code") == "OK", F.lit("succeeded"))
        .otherwise(F.lit("failed")),
    )


def committed_prefix(outcomes: DataFrame) -> DataFrame:
    """Batches run in order per catalog and the first unsuccessful one stops it:
    a batch is committed when it succeeded and no earlier batch did not.

    The first stop per catalog is an aggregate (combined map-side) joined back,
    so a giant catalog is never one window task.
    """
    stops = outcomes.where(F.col("outcome") != "succeeded").groupBy("catalog_id").agg(
        F.min("batch_no").alias("stop_batch")
    )
    return spread_join(outcomes, stops, ["catalog_id"], by=["batch_no"], how="left").withColumn(
        "committed",
        (F.col("outcome") == "succeeded") & (F.col("stop_batch").isNull() | (F.col("batch_no") < F.col("stop_batch"))),
    )
