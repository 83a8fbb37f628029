"""Merge accepted translations into the entries table and annotate them.

Order per result: apply -> (include_fuzzy) clear fuzzy -> mark machine
translated -> (add_fuzzy) add fuzzy. Only entries that received a result are
touched. The join key ``(catalog_id, msgctxt, msgid)`` is unique per entry, so
the hash join spreads even one giant catalog evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.functions.text import FUZZY, MACHINE_MARKER, js_trim, split_lines
from potable.operators.numbering import materialize

KEY = ["catalog_id", "msgctxt", "msgid"]


def mark_machine_translated(translator: Column) -> Column:
    """Add the ``ai-translated`` line unless a trimmed line already equals it;
    appended on a new line to existing text (whitespace-only text counts)."""
    has = F.exists(split_lines(translator), lambda x: js_trim(x) == F.lit(MACHINE_MARKER))
    return (
        F.when(translator.isNull() | (F.length(translator) == 0), F.lit(MACHINE_MARKER))
        .when(has, translator)
        .otherwise(F.concat(translator, F.lit("\n" + MACHINE_MARKER)))
    )


def add_fuzzy(flag: Column) -> Column:
    """Append ``fuzzy``: already fuzzy -> unchanged (not re-spaced); otherwise the
    trimmed non-empty flags plus ``fuzzy`` joined by ', '; null/empty -> ``fuzzy``."""
    tokens = F.filter(F.transform(F.split(flag, ","), lambda x: js_trim(x)), lambda x: x != F.lit(""))
    already = F.exists(tokens, lambda x: F.lower(x) == F.lit(FUZZY))
    return (
        F.when(flag.isNull() | (F.length(flag) == 0), F.lit(FUZZY))
        .when(already, flag)
        .otherwise(F.array_join(F.concat(tokens, F.array(F.lit(FUZZY))), ", "))
    )


def clear_fuzzy(flag: Column) -> Column:
    """Remove ``fuzzy`` (any case) and re-join with ', '; empty segments are kept,
    an empty result becomes null; null/empty flags are left alone."""
    rest = F.filter(F.transform(F.split(flag, ","), lambda x: js_trim(x)), lambda x: F.lower(x) != F.lit(FUZZY))
    joined = F.array_join(rest, ", ")
    return F.when(flag.isNull() | (F.length(flag) == 0), flag).otherwise(F.when(joined == "", F.lit(None)).otherwise(joined))


def latest_results(results: DataFrame) -> DataFrame:
    """One result per entry key: the last one applied wins (by batch, then position)."""
    return (
        results.groupBy(*KEY)
        .agg(F.max_by(F.col("msgstr"), F.struct("batch_no", "pos")).alias("new_msgstr"))
    )


def _option(v: bool | str) -> Column:
    return F.coalesce(F.col(v), F.lit(False)) if isinstance(v, str) else F.lit(bool(v))


def apply_translations(
    entries: DataFrame, results: DataFrame, include_fuzzy: bool | str = False, add_fuzzy_flag: bool | str = False
) -> DataFrame:
    """Entries with results merged and annotated; adds ``translated_now``.

    ``include_fuzzy`` / ``add_fuzzy_flag`` are job-wide booleans or names of
    boolean columns of ``entries`` (per-catalog options).
    """
    # written, so that its size is known: a small one is sent to the entries, not they to it
    r = materialize(latest_results(results.withColumn("msgctxt", F.coalesce(F.col("msgctxt"), F.lit("")))), "latest-results")
    j = entries.join(r, on=KEY, how="left")
    hit = F.col("new_msgstr").isNotNull()
    flag = F.col("flag")
    flag = F.when(hit & _option(include_fuzzy), clear_fuzzy(flag)).otherwise(flag)
    translator = F.when(hit, mark_machine_translated(F.col("translator"))).otherwise(F.col("translator"))
    flag = F.when(hit & _option(add_fuzzy_flag), add_fuzzy(flag)).otherwise(flag)
    return (
        j.withColumn("msgstr", F.coalesce(F.col("new_msgstr"), F.col("msgstr")))
        .withColumn("flag", flag)
        .withColumn("translator", translator)
        .withColumn("translated_now", hit)
        .drop("new_msgstr")
    )
