"""Mixing sources to target weights, with DataFrame functions only.

Capped water-filling: a source's target is its weight times one level, clamped
at ``max_epochs`` times its size; what a clamped source cannot take is shared
again by weight among the others. With the sources sorted by cap over weight,
the level is the largest of ``(budget - caps before k) / (weights from k on)``
(clamping a source raises that figure exactly when the source lies below it).

Sampling: a document is taken ``floor(target / source size)`` whole times. The
fraction is taken by a seeded hash: documents fall into ``bins`` by their hash,
bins are taken whole in order until the rest of the target is reached, and each
document of the last bin gives the fraction of its words that is still missing.
So a source's total differs from its target by at most the rounding in one bin.

Everything but two scans of a narrow written table works on one row per
(source, bin) or per source. The per-source row is joined on (source, salt), so
a source with a third of all documents is dealt over ``salts`` join keys.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; sources of size 0 have target 0; equal
``doc_id`` rows draw the same number; empty tables give empty results; other
columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potable.llm.common import WORD_PATTERN, written

SALTS = 64


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_unit(seed: int, key: Column, part: int) -> Column:
    """A number in [0, 1) from eight hex digits of a seeded md5 (the same in any engine)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """(source, source_size) -> adds ``target``; one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    i = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
        )
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    bins: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``mix`` = struct(size, source_size, target, taken); ``taken`` counts words, repeats included."""
    u = hash_unit(seed, F.col(id_col), 0)
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
        F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        F.floor(u * bins).cast("int").alias("bin"), hash_unit(seed, F.col(id_col), 1).alias("v"),
    )
    binned = written(base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    targets = source_targets(
        binned.groupBy("source").agg(F.sum("bin_size").cast("long").alias("source_size")), weights, share, max_epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        binned.withColumn("upto", F.sum("bin_size").over(up_to))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("s").agg(F.min(F.struct("bin", "upto", "bin_size")).alias("c"))
        .select(
            F.col("s").alias("cs"), F.col("c.bin").alias("cut_bin"),
            ((F.col("c.bin_size") - F.col("c.upto")) / F.col("c.bin_size")).alias("base_fraction"),
            F.col("c.bin_size").alias("cut_size"),
        )
    )
    plan = (
        targets.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
        .select(
            F.col("source").alias("ps"), "source_size", "target", "whole",
            F.coalesce("cut_bin", F.lit(bins)).alias("cut_bin"),
            F.coalesce(F.col("rest") / F.col("cut_size") + F.col("base_fraction"), F.lit(0.0)).alias("fraction"),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    plan = written(plan, "mix-plan")
    size, b = F.col("size"), F.col("bin")
    part = F.least(size, F.floor(size * F.col("fraction") + F.col("v")).cast("long"))
    extra = F.when(b < F.col("cut_bin"), size).when(b == F.col("cut_bin"), part).otherwise(F.lit(0))
    salted = base.withColumn("salt", F.pmod(F.col("bin"), F.lit(SALTS)))
    return salted.join(
        plan.withColumnRenamed("salt", "psalt"),
        (F.col("salt") == F.col("psalt")) & F.col("source").eqNullSafe(F.col("ps")),
    ).select(
        "d.*",
        F.struct(
            size, "source_size", "target", (F.col("whole") * size + extra).cast("long").alias("taken")
        ).alias("mix"),
    )


def repeat_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row per whole repetition (a last part counts from half the text on)."""
    size, taken = F.col("mix.size"), F.col("mix.taken")
    times = F.when(size > 0, F.floor(taken / size + F.lit(0.5))).otherwise(F.lit(1)).cast("int")
    rows = mixed.select(*[F.col(f"`{c}`") for c in columns], times.alias("__times")).where("__times > 0")
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(
        *[F.col(f"`{c}`") for c in columns]
    )
