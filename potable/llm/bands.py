"""Where the bulk of each language's documents lies, whatever junk and copies surround it.

Each distinct content counts once. A source of ``n`` contents weighs the square root
of ``n``, so that a hot source doesn't speak for its language. The shortest interval
that holds half of the weight lies inside the bulk as long as that has more than
half of the weight, on whichever side the rest lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.workers import over_group

#: steps of a nat at which values are counted (a language's rows are bounded by their range)
PER_NAT = 512
#: half-lengths below this (2 % of a perplexity) are not told apart from evenness
LEAST_HALF = 0.02


def shortest_half(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Mean and half length of the shortest run of sorted steps with half of the weight (``total``: weighted sums of values)."""
    upto = np.concatenate([[0], np.cumsum(weight)])
    end = np.searchsorted(upto, upto[:-1] + upto[-1] / 2 * (1 - 1e-9))
    begin = np.flatnonzero(end < len(upto))
    length = at[end[begin] - 1] - at[begin] + 1
    same = begin[length == length.min()]
    first = same[len(same) // 2]
    inside = slice(first, end[first])
    return total[inside].sum() / weight[inside].sum(), length.min() / 2 / PER_NAT


@over_group
def _bulk(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("at").to_numpy())
    center, half = shortest_half(*(table.column(c).to_numpy()[order] for c in ("at", "weight", "total")))
    docs = int(table.column("k").to_numpy().sum())
    half = max(half, LEAST_HALF) * (1 + 5 / docs)  # the shortest half of few values is too short
    return pa.table({"lang": table.column("lang").slice(0, 1), "center": [center], "half": [half], "docs": [docs]})


def bulk(rows: DataFrame, value: str) -> DataFrame:
    """(lang, center, half, docs) of ``rows`` = (lang, source, content, ``value``), a row per language."""
    once = rows.groupBy("lang", "content").agg(
        F.min("source").alias("source"), F.min(value).alias("v")
    ).withColumn("at", F.floor(F.col("v") * PER_NAT))
    steps = once.groupBy("lang", "source", "at").agg(F.count("*").alias("k"), F.sum("v").alias("v"))
    sizes = steps.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("k").alias("size"))
    weighed = steps.join(sizes, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    return (
        weighed.groupBy("lang", "at").agg(
            F.sum(F.col("k") / F.sqrt("size")).alias("weight"), F.sum(F.col("v") / F.sqrt("size")).alias("total"),
            F.sum("k").alias("k"),
        )
        .groupBy("lang").applyInArrow(_bulk, "lang string, center double, half double, docs long")
    )
