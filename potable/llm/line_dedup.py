"""Line de-duplication across documents, with DataFrame functions only.

1. each text is split at ``\\n``; a line's key is the line without ASCII white
   space at both ends and with A-Z lower-cased;
2. keys of at least ``min_chars`` code points are exploded as
   ``(128-bit hash, document, position)``, once, into a written table;
3. documents per hash are counted in two partial aggregations, first per
   ``(hash, doc_id)``, then per hash, so a line found in a third of all
   documents never meets one task as raw rows;
4. hashes of at least ``min_docs`` documents are joined back to the exploded
   rows (a plain sort-merge join, whose large partitions AQE splits);
5. the dropped positions of a document are gathered (bounded by its own lines)
   and the rest of its lines joined again by position.

Defined results: a null or empty text is one empty line and never loses it;
repeated rows of one ``doc_id`` are one document when documents are counted, and
each such row gets its own result; rows without a ``doc_id`` hold lines but count
as no document, and lose a line like any document that isn't its holder; an
empty table gives an empty result; other columns, whatever their names, pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.llm.common import WHITE, ascii_lower, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``docs`` with columns ``dedup`` = struct(text, n_lines, n_dropped).

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines except those of the largest ``doc_id`` holding it.
    """
    row_key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    lines = (
        docs.select(row_key.alias("k"), F.posexplode(_lines(text_col)).alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars)
        .select("k", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2"),
            F.col("k.id").alias("id"), F.col("k.t").alias("t"), "pos",
        )
    )
    lines = written(lines, "lines")
    frequent = (
        lines.where("id is not null").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    )
    frequent = written(frequent, "frequent-lines")
    dropped = (
        lines.join(frequent, ["h1", "h2"])
        .where(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
        .groupBy("id", "t").agg(F.collect_set("pos").alias("pos"))
        .select(F.struct(F.col("id"), F.col("t")).alias("k"), "pos")
    )
    # only the documents' own columns go through the join beside the positions
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), row_key.alias("k"))
    joined = left.join(
        dropped.select(
            F.col("k.t").alias("dt"), F.col("k.id").alias("did"), F.col("pos").alias("drop_pos")
        ),
        (F.col("k.t") == F.col("dt")) & F.col("k.id").eqNullSafe(F.col("did")), "left",
    )
    parts = joined.select(
        "d", F.split(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")), "\n", -1).alias("lines"),
        F.coalesce("drop_pos", F.array().cast("array<int>")).alias("drop_pos"),
    )
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop_pos"))
    text = F.when(F.size("drop_pos") == 0, F.col(f"d.`{text_col}`")).otherwise(
        F.array_join(F.transform(kept, lambda p: F.get(F.col("lines"), p)), "\n")
    )
    return parts.select(
        "d.*",
        F.struct(
            F.coalesce(text, F.lit("")).alias("text"), n.cast("long").alias("n_lines"),
            F.size("drop_pos").cast("long").alias("n_dropped"),
        ).alias("dedup"),
    )
