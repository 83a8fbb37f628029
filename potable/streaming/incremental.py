"""Incremental work-lists over catalog files that arrive or change (Structured Streaming).

A file source takes every path once, so an edited file would never be read again.
Here the stream reads *changes*: ``announce_changes`` compares the files' names, times
and lengths with the versions taken before and writes the new ones as one manifest,
a file per shard of catalogs. The stream takes one manifest file per micro-batch, and
``foreachBatch`` reads the files of the catalogs that it names, whole.

Tables under ``out_dir``, each with a folder per shard and epoch (the manifest's number)
that a replay overwrites, so nothing doubles. ``versions`` is written last: a
manifest whose versions are there has been taken, whatever the stream remembers, so a
lost stream checkpoint does no harm either.

* ``requests``: the batches to send. Only items that no earlier epoch of the catalog
  has sent, so an edited file sends its new or reworded entries; batch numbers go on
  where the catalog stopped.
* ``sent``: keys of the items sent, 128 bits each, with their batch.
* ``catalogs``: one row per catalog read, its items and batches, also where there are none.
* ``versions``: the files taken (path, time, length) with a hash of their lines, so a
  file that was only touched shows as ``same``.

A shard's state is its own folders only. The driver holds the paths of one manifest
file; choose ``shards`` so that these are few thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators import batching
from potable.operators import select as sel
from potable.operators.numbering import exists, materialize
from potable.operators.spread import spread_join
from potable.sources.po_text import catalog_id_of, classify_line_rows, line_parts, place_lines, scanned_entries

SHARDS = 64
MANIFEST = "shard int, epoch long, catalog_id string, path string, modified timestamp, length long"
VERSIONS = "path string, modified timestamp, length long, catalog_id string, content long, same boolean"
SENT = "catalog_id string, k1 long, k2 long, batch_no long"


def _listing(spark: SparkSession, in_dir: str, shards: int) -> DataFrame:
    """One row per file: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(in_dir)
    found = files.select("path", F.col("modificationTime").alias("modified"), "length")
    found = found.withColumn("catalog_id", catalog_id_of(F.col("path"), in_dir))
    return found.withColumn("shard", F.pmod(F.xxhash64("catalog_id"), F.lit(shards)).cast("int"))


def _state(spark: SparkSession, out_dir: str, table: str, schema: str, shard: Column | None = None, before: int | None = None) -> DataFrame:
    """Rows of a state table: one shard's, and of epochs before one, where given."""
    path = f"{out_dir}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, shard int, epoch long")
    rows = spark.read.schema(f"{schema}, shard int, epoch long").option("basePath", path).parquet(path)
    if shard is not None:
        rows = rows.where(shard)
    return rows if before is None else rows.where(F.col("epoch") < before)


def announce_changes(spark: SparkSession, in_dir: str, out_dir: str, shards: int = SHARDS) -> None:
    """Write a manifest of all files of the catalogs in which a file is new or changed.

    A file that vanished sends nothing, and its catalog is read again when another changes.
    """
    now = materialize(_listing(spark, in_dir, shards), "file-listing")
    known = _state(spark, out_dir, "versions", VERSIONS).select("path", "modified", "length")
    changed = now.join(known, ["path", "modified", "length"], "left_anti").select("catalog_id").distinct()
    epoch = 0
    if exists(spark, f"{out_dir}/manifests"):
        epoch = (spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifests").agg(F.max("epoch").alias("e")).first()["e"] or 0) + 1
    rows = now.join(changed, "catalog_id", "left_semi").withColumn("epoch", F.lit(epoch).cast("long"))
    # one file a shard: the rows of a shard are paths, and few by the choice of shards
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).repartition(shards, "shard").sortWithinPartitions("shard").withColumn(
        "of", F.col("shard")).write.mode("append").partitionBy("of").parquet(f"{out_dir}/manifests")


def _item_keys() -> list[Column]:
    """128 bits of what an item asks: context, msgid and plural text."""
    parts = ["msgctxt", "msgid", F.coalesce(F.col("msgid_plural"), F.lit("")), F.col("msgid_plural").isNull()]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("sent"), *parts).alias("k2")]


def _plain(path: Column) -> Column:
    """A path as both the listing and the line scan name it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def take_changes(spark: SparkSession, manifest: DataFrame, in_dir: str, out_dir: str, include_fuzzy: bool = False) -> None:
    """One micro-batch: each manifest file in it (normally one) is taken, unless it was before."""
    files = manifest.select("epoch", "shard", "path", "modified", "length", "catalog_id").collect()
    for epoch, shard in sorted({(r["epoch"], r["shard"]) for r in files}):
        if not exists(spark, f"{out_dir}/versions/shard={shard}/epoch={epoch}"):
            own = [tuple(r)[2:] for r in files if (r["epoch"], r["shard"]) == (epoch, shard)]
            _take(spark, own, shard, epoch, in_dir, out_dir, include_fuzzy)


def _take(spark: SparkSession, files: list[tuple], shard: int, epoch: int, in_dir: str, out_dir: str, include_fuzzy: bool) -> None:
    """(path, modified, length, catalog_id) of one shard -> requests and state of ``epoch``."""

    def keep(table: DataFrame, name: str) -> None:
        table.write.mode("overwrite").parquet(f"{out_dir}/{name}/shard={shard}/epoch={epoch}")

    def state(table: str, schema: str) -> DataFrame:
        return _state(spark, out_dir, table, schema, F.col("shard") == shard, epoch).drop("shard")

    named = spark.createDataFrame(files, "path string, modified timestamp, length long, catalog_id string")
    raw = spark.read.text([f[0] for f in files]).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.col("value").alias("line")
    )
    lines = materialize(line_parts(classify_line_rows(place_lines(raw)), hashed=True), "po-parts", "zstd")
    work = sel.worklist(scanned_entries(lines, in_dir), include_fuzzy=include_fuzzy).select(
        "catalog_id", "seq", "ctx_first", "msgctxt", "msgid", "msgid_plural", *_item_keys()
    )
    sent = state("sent", SENT)
    fresh = work.join(sent.select("catalog_id", "k1", "k2"), ["catalog_id", "k1", "k2"], "left_anti")
    upto = sent.groupBy("catalog_id").agg(F.max("batch_no").alias("upto"))
    numbered = spread_join(batching.number_batches(fresh), upto, ["catalog_id"], by=["seq"], how="left")
    numbered = numbered.withColumn("batch_no", F.col("batch_no") + F.coalesce("upto", F.lit(0))).drop("upto")
    numbered = materialize(numbered, "incremental-items")
    keep(batching.batch_requests(numbered), "requests")
    items = numbered.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("batch_no").alias("n_batches"))
    keep(named.select("catalog_id").distinct().join(items, "catalog_id", "left").fillna(0, ["n_items", "n_batches"]), "catalogs")
    keep(numbered.select("catalog_id", "k1", "k2", "batch_no"), "sent")
    hashes = lines.groupBy(_plain(F.col("path")).alias("__p")).agg(F.bit_xor("content").alias("content"))
    old = state("versions", VERSIONS).groupBy("path").agg(F.max_by("content", "epoch").alias("__old"))
    seen = named.withColumn("__p", _plain(F.col("path"))).join(hashes, "__p", "left").drop("__p").join(old, "path", "left")
    keep(seen.withColumn("same", F.coalesce(F.col("content") == F.col("__old"), F.lit(False))).drop("__old"), "versions")


def incremental_worklist(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, include_fuzzy: bool = False, shards: int = SHARDS
) -> None:
    """Process every PO file under ``in_dir`` that is new or changed; append to the tables under ``out_dir``."""
    out_dir = out_dir.rstrip("/")
    announce_changes(spark, in_dir, out_dir, shards)
    stream = (
        spark.readStream.schema(MANIFEST).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        .parquet(f"{out_dir}/manifests")
    )
    q = (
        stream.writeStream.foreachBatch(lambda batch, _: take_changes(spark, batch, in_dir, out_dir, include_fuzzy))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
