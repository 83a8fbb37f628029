"""Catalog tables derived from the driver's ``documents`` table.

One line of a document is one candidate entry and ``source.lang`` is one
catalog. Entry fields come from arithmetic on ``doc_id`` and the line number
(see FIXTURES.md §3), so the same tables can be rebuilt in any SQL engine and
compared. Everything scales with ``documents``: whole texts are exploded, no
row caps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators.locale import language_dim
from potable.operators.numbering import materialize, running_total
from potable.operators.spread import spread_join
from potable.sources.tables import read_table


def catalog_lines(documents: DataFrame) -> DataFrame:
    """documents -> one row per line: doc_id, lang, source, line_no, line."""
    return documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line")
    ).select("doc_id", "lang", "source", F.col("pos").cast("bigint").alias("line_no"), "line")


def _arr(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def line_entries(lines: DataFrame) -> DataFrame:
    """Lines -> one narrow row per candidate entry: its catalog, place (document, line) and line."""
    return lines.select(
        F.concat_ws(".", "source", "lang").alias("catalog_id"),
        "lang",
        "doc_id",
        "line_no",
        (F.col("doc_id") * 31 + F.col("line_no") * 7).alias("h"),
        F.col("line").alias("base"),
    )


def entry_context() -> Column:
    return (
        F.when(F.col("doc_id") % 17 == 1, (F.col("doc_id") % 4).cast("string"))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ctx"), (F.col("doc_id") % 2).cast("string")))
        .otherwise(F.lit(""))
    )


def entry_fields(e: DataFrame, *more: str) -> DataFrame:
    """Narrow rows -> entries (``f`` in FIXTURES.md). Fields repeat the line, so rows are joined and written without them."""
    h = F.col("h")
    base = F.col("base")
    line_no = F.col("line_no")
    return e.select(
        "catalog_id",
        "lang",
        "h",
        "base",
        *[c for c in ("seq", "ctx_first") if c in e.columns],
        *more,
        entry_context().alias("msgctxt"),
        F.when(h % 101 == 0, F.lit(""))
        .when(h % 97 == 5, (h % 50).cast("string"))
        .when(h % 97 == 6, F.concat((h % 50).cast("string"), F.lit("\n")))
        .when(line_no % 5 == 1, F.concat(base, F.lit(" %d")))
        .when(line_no % 5 == 2, F.concat(F.lit("<b>"), base, F.lit("</b> {name}")))
        .otherwise(base)
        .alias("msgid"),
        F.when(h % 8 == 0, F.lit("fuzzy"))
        .when(h % 8 == 1, F.lit("c-format, fuzzy"))
        .when(h % 8 == 2, F.lit("c-format"))
        .when(h % 8 == 3, F.lit(" Fuzzy "))
        .when(h % 8 == 4, F.lit("fuzzy-ish"))
        .when(h % 8 == 5, F.lit(""))
        .alias("flag"),
        F.when(h % 9 == 0, F.lit("ai-translated"))
        .when(h % 9 == 1, F.lit("TODO\nai-translated"))
        .when(h % 9 == 2, F.lit("note"))
        .when(h % 9 == 3, F.lit(""))
        .alias("translator"),
        # one source is translated throughout, so its catalogs have nothing to do
        F.when(F.col("catalog_id").startswith("src19."), _arr(F.concat(F.lit("t:"), base)))
        .when(h % 11 == 0, F.lit(None).cast("array<string>"))
        .when(h % 7 == 0, F.array().cast("array<string>"))
        .when(h % 13 == 5, _arr(F.lit("\u0085")))
        .when(h % 13 == 6, _arr(F.concat(base, F.lit(" \u0085"))))
        .when(h % 7 == 1, _arr(F.lit("")))
        .when(h % 7 == 2, _arr(F.lit("\t\u00a0")))
        .when(h % 7 == 3, _arr(F.lit(""), F.lit("x")))
        .otherwise(_arr(F.concat(F.lit("t:"), base)))
        .alias("msgstr"),
    ).withColumn(
        "msgid_plural", F.when(h % 6 == 0, F.concat(F.col("msgid"), F.lit(" (pl)")))
    )


KEY = ("catalog_id", "msgctxt", "msgid")


def repeated_keys(entries: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(k1, k2, last, first): ``seq`` of the last and first entry of each key that comes more than once, a written table.

    Keys are 128-bit hashes. Of most keys only half of one is shuffled, which finds the few that may be repeated.
    """
    named = entries.select(F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit("key"), *key).alias("k2"), "seq")
    maybe = materialize(named.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"), "repeated-hashes")
    places = named.join(maybe, "k1", "left_semi").groupBy("k1", "k2").agg(F.max("seq").alias("last"), F.min("seq").alias("first"))
    return materialize(places.where(F.col("last") > F.col("first")), "repeated-keys")


def dedupe_keys(entries: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One entry per key, as a map that keeps insertion order gives it: the entry latest
    in the file overwrites the value, but the key stays where it came first.

    So a row has the content of its key's largest ``seq``, and the smallest as ``seq``.
    """
    named = entries.withColumn("k1", F.xxhash64(*key)).withColumn("k2", F.xxhash64(F.lit("key"), *key))
    found = named.join(repeated_keys(entries, key), ["k1", "k2"], "left").where(F.col("last").isNull() | (F.col("last") == F.col("seq")))
    return found.withColumn("seq", F.coalesce("first", "seq")).select(*entries.columns)


def document_places(docs: DataFrame) -> DataFrame:
    """(catalog_id, doc_id, start, ctx_first) of each document: the lines of its catalog before it, and
    the place where its context is first seen (all lines of a document have one context)."""
    sized = docs.select(
        F.concat_ws(".", "source", "lang").alias("catalog_id"), "doc_id",
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
    )
    starts = running_total(sized, ["catalog_id"], ["doc_id"], "n_lines", "start").withColumn("msgctxt", entry_context())
    first = starts.groupBy("catalog_id", "msgctxt").agg((F.min("start") + 1).alias("ctx_first"))
    return spread_join(starts, first, ["catalog_id", "msgctxt"], by=["doc_id"]).select(
        "catalog_id", "doc_id", "start", "ctx_first"
    )


def entry_rows(documents: DataFrame) -> DataFrame:
    """Narrow rows of the de-duplicated entries, with ``seq`` and ``ctx_first``.

    A line's number in its catalog is its document's start and its own number, so lines are never
    sorted: first and last line of each key are found on hashes and numbers, starts are joined to
    those, and the lines themselves are shuffled once, to the unique (document, line) that they
    are kept for. ``doc_id`` must be unique and not null; a null text has no lines.
    """
    docs = documents.where(F.col("text").isNotNull())
    rows = line_entries(catalog_lines(docs))
    fields = entry_fields(rows.withColumn("at", F.struct("doc_id", "line_no")), "at")
    keys = fields.groupBy(F.xxhash64(*KEY).alias("k1"), F.xxhash64(F.lit("key"), *KEY).alias("k2")).agg(
        F.max("at").alias("last"), F.min("at").alias("first")
    )
    kept = keys.select("last.doc_id", "last.line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))
    starts = document_places(docs).select(F.col("doc_id").alias("first_doc"), "start", "ctx_first")
    placed = kept.join(starts, "first_doc").select(
        "doc_id", "line_no", (F.col("start") + F.col("first_line") + 1).alias("seq"), "ctx_first"
    )
    return rows.join(placed, ["doc_id", "line_no"])


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-duplicated entries (``d`` in FIXTURES.md), header rows included, with ``ctx_first``,
    where the entry's context is first seen. The written table holds each line once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return entry_fields(materialize(entry_rows(docs), "entries", "zstd"))


def header_text(source: Column, lang: Column, formula: Column) -> Column:
    """Header entry text for a catalog. Five shapes by source number: complete,
    no Language, empty Language, lower-case keys with a region, and padded
    Language with extra words plus a repeated key (last one wins)."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint"), F.lit(0)) % 5
    ct = F.lit("Content-Type: text/plain; charset=UTF-8\n")
    return (
        F.when(n == 0, F.concat(F.lit("Language: "), lang, F.lit("\nPlural-Forms: "), formula, F.lit("\n"), ct))
        .when(n == 1, F.concat(F.lit("Plural-Forms: "), formula, F.lit("\n"), ct))
        .when(n == 2, F.concat(F.lit("Language: \n"), ct))
        .when(
            n == 3,
            F.concat(F.lit("language: "), lang, F.lit("_"), F.upper(lang), F.lit("\nplural-forms: "), formula, F.lit("\n"), ct),
        )
        .otherwise(
            F.concat(
                F.lit("Language: xx\nX-Generator: potable\n"),
                F.lit("Language: \t"),
                lang,
                F.lit(" extra\nMIME-Version: 1.0\n"),
                ct,
            )
        )
    )


def catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per catalog: catalog_id, source, lang, header_text.

    Distinct (source, lang) is a partial aggregate; the language dimension is a
    fixed table, so it is broadcast.
    """
    docs = read_table(spark, sf_dir, "documents").select("source", "lang")
    dim = language_dim(spark).select(F.col("code").alias("lang"), "formula")
    cats = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return cats.join(F.broadcast(dim), on="lang", how="left").select(
        F.concat_ws(".", "source", "lang").alias("catalog_id"),
        "source",
        "lang",
        header_text(F.col("source"), F.col("lang"), F.coalesce(F.col("formula"), F.lit(""))).alias("header_text"),
    )
