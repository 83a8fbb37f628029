"""Per-catalog reports: coverage counts and the printed result lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.functions.text import MACHINE_MARKER, is_fuzzy, is_untranslated, js_trim, split_lines


def has_marker(translator: str = "translator") -> F.Column:
    """Translator comment already carries the machine-translation line."""
    return F.coalesce(
        F.exists(split_lines(F.col(translator)), lambda x: js_trim(x) == F.lit(MACHINE_MARKER)), F.lit(False)
    )


def catalog_coverage(entries: DataFrame, include_fuzzy: bool = False) -> DataFrame:
    """entries, untranslated, fuzzy, selected, machine-marked per catalog (header excluded).

    One partial-aggregating ``groupBy``; a hot catalog is combined map-side.
    """
    e = entries.where(F.col("msgid") != F.lit(""))
    u = is_untranslated("msgstr")
    z = is_fuzzy("flag")
    sel = u | (z if include_fuzzy else F.lit(False))
    return e.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(u).alias("n_untranslated"),
        F.count_if(z).alias("n_fuzzy"),
        F.count_if(sel).alias("n_selected"),
        F.count_if(has_marker()).alias("n_machine"),
        F.count_if(F.col("msgid_plural").isNotNull()).alias("n_plural"),
    )


def report_lines(results: DataFrame) -> DataFrame:
    """``  msgid => msgstr`` for singular, ``  plural (plural) => a | b`` for plural results."""
    return results.withColumn(
        "line",
        F.when(
            F.col("msgid_plural").isNull(),
            F.concat(F.lit("  "), F.col("msgid"), F.lit(" => "), F.coalesce(F.try_element_at(F.col("msgstr"), F.lit(1)), F.lit(""))),
        ).otherwise(
            F.concat(
                F.lit("  "), F.col("msgid_plural"), F.lit(" (plural) => "), F.array_join(F.col("msgstr"), " | ")
            )
        ),
    )
