"""Registered queries for real files: PO scan/compile round trip, result commits,
the response log and the streaming work-list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators.numbering import delete, materialize, scratch
from potable.plans.catalog import _MEMO, _key, catalogs, entries, msgstr_text
from potable.plans.queries import query
from potable.plans.translate import Options, commit_run, request_rows, service_log, translate, translate_files
from potable.providers.recorded import recorded_provider
from potable.session import run_folder
from potable.sinks.po_compile import catalog_blocks, catalog_stats, write_entries
from potable.sources.fixture import catalog_entries
from potable.sources.po_text import assemble_entries, po_scan, rejected_lines, scan_lines
from potable.streaming.incremental import incremental_worklist


def _new_folder(spark: SparkSession, label: str) -> str:
    return run_folder(spark, f"{label}-{uuid.uuid4().hex}")


def compiled_folder(spark: SparkSession, sf: str, fold_length: int = 0) -> str:
    """Compile the fixture catalogs to PO files once per session; returns the folder."""
    k = _key(spark, sf, f"po-folder-{fold_length}")
    if k not in _MEMO:
        out = _new_folder(spark, "po")
        with scratch(spark):
            # an entries table that no query of the session has asked for is not kept beside the files
            known = _MEMO.get(_key(spark, sf, "entries"))
            ents = catalog_entries(spark, sf) if known is None else known
            write_entries(ents, catalogs(spark, sf), out, fold_length, codec="gzip")
        _MEMO[k] = out  # type: ignore[assignment]
    return _MEMO[k]  # type: ignore[return-value]


@query("po_scan")
def q_po_scan(spark: SparkSession, sf: str) -> DataFrame:
    """entries -> PO files -> scan: the round trip must give the entries back."""
    ents, _ = po_scan(spark, compiled_folder(spark, sf))
    body = ents.where(~((F.col("msgctxt") == "") & (F.col("msgid") == "")))
    return body.select(
        "catalog_id", "msgctxt", "msgid", "msgid_plural", msgstr_text().alias("msgstr_text"), "flag", "translator"
    )


def broken_folder(spark: SparkSession, sf: str) -> str:
    """The fixture's files with faults: some msgid lines lose their end, junk follows some entries."""
    k = _key(spark, sf, "po-broken")
    if k not in _MEMO:
        text = F.when(F.col("f") % 37 == 5, F.regexp_replace("text", '(?m)^(msgid .*)"$', "$1")).when(
            F.col("f") % 41 == 7, F.concat("text", F.lit("\n<<<<<<< theirs"))).otherwise(F.col("text"))
        out = _new_folder(spark, "po-broken")
        write_entries(entries(spark, sf), catalogs(spark, sf), out, edit=lambda blocks: blocks.withColumn("text", text))
        _MEMO[k] = out  # type: ignore[assignment]
    return _MEMO[k]  # type: ignore[return-value]


@query("po_scan_rejects")
def q_po_scan_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that a scan of files with faults keeps and rejects, by catalog and reason."""
    folder = broken_folder(spark, sf)
    lines = scan_lines(spark, folder)
    kept = assemble_entries(lines, folder).where(~((F.col("msgctxt") == "") & (F.col("msgid") == "")))
    kept = kept.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n_entries")).withColumn("reason", F.lit("kept"))
    gone = rejected_lines(lines, folder).groupBy("catalog_id", "reason").agg(F.count_distinct("path", "entry_no").alias("n_entries"))
    return kept.unionByName(gone).select("catalog_id", "reason", "n_entries")


@query("translate_po_files")
def q_translate_po_files(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog files -> scan -> recorded replies -> merge -> new files, scanned again."""
    k = _key(spark, sf, "translated-files")
    if k not in _MEMO:
        folder = compiled_folder(spark, sf)
        out, run_id = _new_folder(spark, "po-translated"), uuid.uuid4().hex
        with scratch(spark):
            with scratch(spark):
                with scratch(spark):
                    ents, cats = po_scan(spark, folder)
                    requests = materialize(request_rows(ents, cats), "requests", "zstd", outlives=1)
                log = service_log(requests)
            translate_files(spark, folder, out, recorded_provider(log), run_id=run_id, codec="gzip", keep_merged=False)
        delete(spark, run_folder(spark, f"run-{run_id}"))
        _MEMO[k] = out  # type: ignore[assignment]
    back, _ = po_scan(spark, _MEMO[k])  # type: ignore[arg-type]
    body = back.where(~((F.col("msgctxt") == "") & (F.col("msgid") == "")))
    return body.select(
        "catalog_id", "msgctxt", "msgid", "msgid_plural", msgstr_text().alias("msgstr_text"), "flag", "translator"
    )


@query("po_scan_headers")
def q_po_scan_headers(spark: SparkSession, sf: str) -> DataFrame:
    _, cats = po_scan(spark, compiled_folder(spark, sf))
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return cats.select("catalog_id", F.array_join(F.array_sort(pairs), "\u001f").alias("headers_text"), "target_language")


def _compiled(spark: SparkSession, sf: str, fold_length: int = 0) -> DataFrame:
    """The text of every block; header blocks stand at 0."""
    blocks = catalog_blocks(entries(spark, sf), catalogs(spark, sf), fold_length)
    return blocks.select("catalog_id", F.coalesce("f", F.lit(0)).alias("seq"), F.md5("text").alias("text_md5"))


@query("po_compile")
def q_po_compile(spark: SparkSession, sf: str) -> DataFrame:
    return _compiled(spark, sf)


@query("po_compile_folded")
def q_po_compile_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Compiled with fold length 76."""
    return _compiled(spark, sf, fold_length=76)


@query("po_compile_stats")
def q_po_compile_stats(spark: SparkSession, sf: str) -> DataFrame:
    st = catalog_stats(catalog_blocks(entries(spark, sf), catalogs(spark, sf)))
    return st.select("catalog_id", "n_msgid_lines", "n_msgctxt_lines")


@query("commit_results")
def q_commit_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results and attempts of two runs (job-wide and per-catalog options), kept by run id and read back."""
    k = _key(spark, sf, "commit-results")
    if k not in _MEMO:
        out = _new_folder(spark, "committed")
        commit_run(translate(spark, sf), out, "run-1")
        commit_run(translate(spark, sf, Options(per_catalog=True)), out, "run-2")
        _MEMO[k] = out  # type: ignore[assignment]
    results, attempts = (spark.read.parquet(f"{_MEMO[k]}/{name}") for name in ("results", "attempts"))
    return results.select(
        "run_id", F.lit("result").alias("kind"), "catalog_id", "batch_no", F.col("pos").cast("bigint").alias("n"), msgstr_text().alias("value")
    ).unionByName(attempts.select(
        "run_id", F.lit("attempt").alias("kind"), "catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("n"),
        F.col("status").cast("string").alias("value"),
    ))


@query("response_log_scan")
def q_response_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The service's reply bodies, scanned (all of them, also those no run asks for)."""
    return translate(spark, sf)["service_log"].select(
        "catalog_id", "batch_no", F.col("attempt").cast("bigint").alias("attempt"), F.col("status").cast("bigint").alias("status"),
        F.md5("content").alias("content_md5"),
    )


def _first_edition() -> F.Column:
    """Entries that the first edition of the incremental files has already."""
    return (F.col("seq") % 5 != 0) | (F.col("msgid") == "")


@query("incremental_worklist")
def q_incremental_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Items that two runs send: over the files' first edition, then over the whole one in its place."""
    k = _key(spark, sf, "incremental")
    if k not in _MEMO:
        src, out, ckpt = (_new_folder(spark, f"incremental-{x}") for x in ("in", "out", "ckpt"))
        ents, cats = entries(spark, sf), catalogs(spark, sf)
        for edition in (ents.where(_first_edition()), ents):
            write_entries(edition, cats, src)
            incremental_worklist(spark, src, out, ckpt, shards=2)
        _MEMO[k] = out  # type: ignore[assignment]
    sent = spark.read.parquet(f"{_MEMO[k]}/requests").withColumn("item", F.explode("items"))
    return sent.select(
        "catalog_id", F.col("epoch").cast("bigint").alias("edition"), "batch_no", F.col("item.pos").cast("bigint").alias("pos"),
        F.col("item.msgctxt").alias("msgctxt"), F.coalesce("item.msgid_plural", "item.msgid").alias("asked"),
    )
