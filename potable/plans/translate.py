"""End-to-end translation job: work-list -> requests -> attempts -> results -> merge.

The model stage is the only expensive, side-effecting step. A catalog's first failed
batch ends it, as the batches of one file are translated one after another.

* Live calls run as chains (``providers/live``), in waves of up to ``MOST_WAVE``
  batches a catalog, each wave without the catalogs that earlier ones ended. Tasks
  publish their replies as they finish, each by itself, so a run that is killed half-way
  and started again under its id sends only what has no reply yet.
* A recorded log is replayed in rounds of at most ``MAX_ATTEMPTS``; round k answers the
  batches whose latest attempt failed with a retryable error.

Either way the log holds exactly the attempts that going batch by batch would make.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potable.operators import attempts as att
from potable.operators import batching, merge, validate
from potable.operators import select as sel
from potable.operators.locale import lookup_plural_samples, valid_source_languages
from potable.operators.plural_formula import own_plural_samples
from potable.operators.numbering import delete, exists, finished, materialize, once, scratch, scratch_folder, short_shuffles
from potable.operators.request import DEFAULT_MODEL, with_payload
from potable.operators.spread import spread_join
from potable.plans.catalog import _key, catalogs, entries
from potable.providers.live import REPLY_SCHEMA, LiveCalls, call_in_order
from potable.providers.pseudo import pseudo_attempts
from potable.providers.recorded import recorded_provider
from potable.session import run_folder
from potable.sinks.po_compile import write_entries
from potable.sources.po_text import (
    catalog_shard,
    opaque_lines,
    rejected_lines,
    scan_lines,
    scanned_catalogs,
    scanned_entries,
    shard_count,
)
from potable.sources.responses import response_log_scan, write_response_log

Replay = Callable[[DataFrame, int], DataFrame]
Provider = Replay | LiveCalls
LOG_COLUMNS = ["catalog_id", "batch_no", "attempt", "status", "code", "message", "content"]


@dataclass(frozen=True)
class Options:
    include_fuzzy: bool = False
    add_fuzzy: bool = False
    source_language: str | None = None
    context: str | None = None
    model: str | None = None
    per_catalog: bool = False  # take every option from resolve_options (explicit > config)
    own_formula: bool = False  # plural samples of each catalog's own formula, where it can be used


def catalog_options(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved per-catalog options (explicit overrides beat the job config)."""
    from potable.plans.options import catalog_overrides, resolve_options

    return resolve_options(catalog_overrides(spark, sf))


def with_entry_options(ents: DataFrame, options: DataFrame | None) -> DataFrame:
    """Entries with their catalog's ``include_fuzzy`` and ``add_fuzzy`` (per-catalog runs only)."""
    if options is None:
        return ents
    own = options.select("catalog_id", "include_fuzzy", "add_fuzzy")
    return spread_join(ents, own, ["catalog_id"], by=["seq"], how="left")


def request_rows(ents: DataFrame, cats: DataFrame, opts: Options = Options(), options: DataFrame | None = None) -> DataFrame:
    """One row per (catalog, batch) with all that its request is made of: items, language
    fields, samples and the run's options, each text once.

    ``ents`` and ``cats`` come from any scan; ``options`` (one resolved row per
    catalog) drives the run where it is given.
    """
    sampled = own_plural_samples(cats) if opts.own_formula else lookup_plural_samples(cats)
    # written, as its size decides whether requests are shuffled to it
    cats = materialize(sampled.select("catalog_id", "target_language", "formula", "locale", "samples"), "catalog-samples")
    inc: bool | str = opts.include_fuzzy if options is None else "include_fuzzy"
    work = sel.worklist(with_entry_options(ents, options), include_fuzzy=inc)
    if options is not None:
        # a catalog whose source language is not a known code is rejected before
        # any request is built (reported by invalid_source_languages)
        ok = valid_source_languages(options, "source_lang").select("catalog_id")
        work = spread_join(work, ok, ["catalog_id"], by=["seq"], how="left_semi")
    # number only what a request item needs
    work = work.select("catalog_id", "seq", "ctx_first", "msgctxt", "msgid", "msgid_plural")
    reqs = spread_join(batching.batch_requests(batching.number_batches(work)), cats, ["catalog_id"], by=["batch_no"])
    model = F.lit(opts.model or DEFAULT_MODEL)
    if options is not None:
        o = options.select("catalog_id", "source_lang", "context", "model")
        reqs = spread_join(reqs, o, ["catalog_id"], by=["batch_no"], how="left")
        return reqs.withColumn("model", F.coalesce(F.col("model"), model))
    return reqs.withColumn("source_lang", F.lit(opts.source_language).cast("string")).withColumn(
        "context", F.lit(opts.context).cast("string")).withColumn("model", model)


def as_requests(rows: DataFrame) -> DataFrame:
    """``request_rows`` with payload, system message and call parameters."""
    calls = with_payload(rows, source_language=F.col("source_lang"), context=F.col("context"), model=F.col("model"))
    return calls.drop("source_lang", "context")


def requests_table(ents: DataFrame, cats: DataFrame, opts: Options = Options(), options: DataFrame | None = None) -> DataFrame:
    """One row per (catalog, batch) with items, language fields, samples and payload."""
    return as_requests(request_rows(ents, cats, opts, options))


def written_requests(ents: DataFrame, cats: DataFrame, opts: Options, options: DataFrame | None, run_id: str) -> DataFrame:
    """The requests of a run, made once and kept under its id (payloads are projections of the kept rows)."""
    spark = ents.sparkSession
    path = run_folder(spark, f"run-{run_id}") + "/requests"
    return as_requests(once(spark, lambda: request_rows(ents, cats, opts, options), path))


VERDICT_COLUMNS = ["error_code", "error_pos", "retryable"]


#: what validation reads of a request
ASKED = ["items", "n_items", "samples"]


def _checked(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """The log of a reply table with its verdicts; replies may carry their requests' items already.

    Callers write it, as reading verdicts back from a table keeps later filters
    from re-inlining the whole validation expression."""
    if not set(ASKED) <= set(raw.columns):
        raw = requests.select("catalog_id", "batch_no", *ASKED).join(raw, on=["catalog_id", "batch_no"], how="inner")
    checked = validate.validate(raw)
    return checked.select(*LOG_COLUMNS, *VERDICT_COLUMNS)


def _stops(log: DataFrame) -> DataFrame:
    """(catalog_id, stop_batch): the first batch of a catalog that failed for good."""
    final = log.where((F.col("error_code") != "OK") & (~F.col("retryable") | (F.col("attempt") >= att.MAX_ATTEMPTS)))
    # written: one row a catalog, so that the log itself is not shuffled to it
    return materialize(final.groupBy("catalog_id").agg(F.min("batch_no").alias("stop_batch")), "stops")


def until_first_failure(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """``rows`` of batches up to their catalog's first failed one."""
    found = spread_join(rows, stops, ["catalog_id"], by=["batch_no"], how="left")
    return found.where(F.col("stop_batch").isNull() | (F.col("batch_no") <= F.col("stop_batch"))).drop("stop_batch")


def _union(logs: list[DataFrame]) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def replayed_attempts(requests: DataFrame, replay: Replay, folder: str, shards: int = 1) -> DataFrame:
    """Rounds: attempt 1 for every request, by shards of catalogs, then only retryable failures ahead of a stop."""
    spark = requests.sparkSession
    pending, rounds = requests, []
    for k in range(1, att.MAX_ATTEMPTS + 1):
        if k == 1 and shards > 1:
            # requests and replies meet in a wide shuffle, of one shard at a time
            log = _union([
                once(spark, lambda: _checked(requests, replay(pending.where(catalog_shard(shards) == i), k)), f"{folder}/round-{k}/{i}-of-{shards}")  # noqa: B023
                for i in range(shards)
            ])
        else:
            log = once(spark, lambda: _checked(requests, replay(pending, k)), f"{folder}/round-{k}")  # noqa: B023
        rounds.append(log)
        if k == att.MAX_ATTEMPTS:
            break
        retry = log.where((F.col("error_code") != "OK") & F.col("retryable")).select("catalog_id", "batch_no")
        # written: few against all requests, and then known to be few
        retry = materialize(until_first_failure(retry, _stops(_union(rounds))), "retry")
        pending = materialize(requests.join(retry, on=["catalog_id", "batch_no"], how="left_semi"), "pending")
    whole = _union(rounds)
    return until_first_failure(whole, _stops(whole))


#: batches of a catalog in the first wave, and at most in any (each wave doubles)
FIRST_WAVE, MOST_WAVE = 16, 512


def _published(spark: SparkSession, path: str) -> DataFrame:
    """Replies that tasks have published there, one per attempt (a repeated task may publish twice)."""
    if not exists(spark, path):
        return spark.createDataFrame([], REPLY_SCHEMA)
    return spark.read.schema(REPLY_SCHEMA).parquet(path).dropDuplicates(["catalog_id", "batch_no", "attempt"])


def _publish(replies: DataFrame, path: str) -> None:
    """Append; every task's file appears when that task ends, not with the job."""
    replies.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def live_attempts(requests: DataFrame, live: LiveCalls, folder: str) -> DataFrame:
    """Waves of chained calls; no batch behind a failed one is sent.

    Waves grow from ``FIRST_WAVE`` to ``MOST_WAVE`` batches a catalog: a catalog of n
    batches takes about n / ``MOST_WAVE`` waves, and a task that is lost repeats at most
    its catalogs' parts of one wave.
    """
    spark = requests.sparkSession
    last = requests.agg(F.max("batch_no").alias("n")).first()["n"] or 0
    replies, waves = f"{folder}/replies", []
    low, width, going = 0, FIRST_WAVE, requests
    while low < last:
        high = low + width
        wave = going.where((F.col("batch_no") > low) & (F.col("batch_no") <= high))
        path = f"{folder}/wave-{low + 1}-{high}"
        if not finished(spark, path):
            known = _published(spark, replies).where((F.col("batch_no") > low) & (F.col("batch_no") <= high))
            answered = known.groupBy("catalog_id", "batch_no").agg(
                F.collect_list(F.struct("attempt", "status", "code", "message", "content")).alias("answered"))
            _publish(call_in_order(wave.join(answered, ["catalog_id", "batch_no"], "left"), live), replies)
        log = once(spark, lambda: _checked(wave, _published(spark, replies)), path)  # noqa: B023
        waves.append(log)
        good = log.where("error_code = 'OK'").select("catalog_id", "batch_no").distinct()
        ended = wave.select("catalog_id", "batch_no").join(good, ["catalog_id", "batch_no"], "left_anti").select("catalog_id").distinct()
        ended = materialize(ended, "ended-catalogs")
        going = spread_join(going, ended, ["catalog_id"], by=["batch_no"], how="left_anti")
        low, width = high, min(2 * width, MOST_WAVE)
    if not waves:
        return _checked(requests, _published(spark, replies))
    whole = _union(waves)
    return until_first_failure(whole, _stops(whole))


def run_attempts(requests: DataFrame, provider: Provider, run_id: str | None = None, shards: int = 1) -> DataFrame:
    """The append-only attempt log of a run, with verdict columns.

    Replies are written before anything reads them (a paid call happens once even if
    later stages are recomputed). The tables are named by run: one that is started again
    under its ``run_id`` reads what it has and sends only what is missing.
    """
    folder = run_folder(requests.sparkSession, f"run-{run_id or uuid.uuid4().hex}")
    if isinstance(provider, LiveCalls):
        return materialize(live_attempts(requests, provider, folder), "attempts", outlives=1)
    return materialize(replayed_attempts(requests, provider, folder, shards), "attempts", outlives=1)


def validated_attempts(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Attempt log joined to its requests (by batch) and validated."""
    return validate.validate(requests.join(log.select(*LOG_COLUMNS), on=["catalog_id", "batch_no"], how="inner"))


def committed_results(requests: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch outcomes with ``committed``, result rows of committed batches).

    Outcomes come from the verdict columns of the log; only the accepted final
    attempts are parsed again to read their translations.
    """
    outcomes = att.committed_prefix(att.resolve_attempts(log))
    good = outcomes.where("committed").select("catalog_id", "batch_no", F.col("final_attempt").alias("attempt"))
    accepted = log.join(good, on=["catalog_id", "batch_no", "attempt"], how="left_semi")
    with_items = requests.select("catalog_id", "batch_no", "items").join(accepted, on=["catalog_id", "batch_no"], how="inner")
    return outcomes, validate.align_response(validate.parse_replies(with_items))


def run_job(
    ents: DataFrame, cats: DataFrame, opts: Options, provider: Provider, options: DataFrame | None = None, run_id: str | None = None,
    shards: int = 1,
) -> dict[str, DataFrame]:
    """Requests, attempts, outcomes, results and merged entries of one run, by name.

    With a ``run_id``, requests and finished rounds of an earlier try are used again.
    """
    run_id = run_id or uuid.uuid4().hex
    reqs = written_requests(ents, cats, opts, options, run_id)
    log = run_attempts(reqs, provider, run_id, shards)
    outcomes, results = committed_results(reqs, log)
    outcomes, results = materialize(outcomes, "outcomes", outlives=1), materialize(results, "results", "zstd", outlives=1)
    if options is None:
        merged = merge.apply_translations(ents, results, include_fuzzy=opts.include_fuzzy, add_fuzzy_flag=opts.add_fuzzy)
    else:
        merged = merge.apply_translations(
            with_entry_options(ents, options), results, include_fuzzy="include_fuzzy", add_fuzzy_flag="add_fuzzy"
        ).drop("include_fuzzy", "add_fuzzy")
    return {"requests": reqs, "attempts": log, "validated": log, "outcomes": outcomes, "results": results, "merged": merged}


def translate_files(
    spark: SparkSession, in_dir: str, out_dir: str, provider: Provider, opts: Options = Options(), fold_length: int = 0,
    run_id: str | None = None, options: DataFrame | None = None, codec: str | None = None, keep_merged: bool = True,
) -> dict[str, DataFrame]:
    """The job on catalog files: scan, translate, merge, and write new versions to ``out_dir``.

    Obsolete blocks and header comments are carried over; the input is never
    overwritten. Started again under its ``run_id``, it sends no request twice.
    ``options`` (one resolved row per catalog) drives each catalog's run, its fold length
    included. A catalog with a line that can't be read is neither sent nor written, as
    nothing could put that line back: its lines are the table ``rejects``.

    What wide shuffles are needed for goes through shards of catalogs (up to ``SHARDS``), one after
    another, and tables that steps only read are deleted with the step. Without ``keep_merged``
    so are the scanned entries, each shard's when its files are written; the merged entries
    are then in the files only. ``codec`` compresses the files.
    """
    n = shard_count(spark, in_dir)
    with scratch(spark, keep=keep_merged):
        with scratch(spark):
            lines = scan_lines(spark, in_dir)
            rejects = materialize(rejected_lines(lines, in_dir), "rejects", outlives=2)
            faulty = materialize(rejects.select("catalog_id").distinct(), "faulty-catalogs")
            ents = spread_join(scanned_entries(lines, in_dir), faulty, ["catalog_id"], by=["seq"], how="left_anti")
            scanned = scratch_folder(spark, "scanned", outlives=1)
            with short_shuffles(spark):
                ents.withColumn("shard", catalog_shard(n)).write.partitionBy("shard").parquet(scanned, compression="zstd")
            opaque = opaque_lines(lines, in_dir).join(faulty, "catalog_id", "left_anti")
            opaque = materialize(opaque, "opaque", "zstd", outlives=1)
        whole = spark.read.schema(f"{_ddl(ents)}, shard int").parquet(scanned)
        cats = materialize(scanned_catalogs(whole.drop("shard")), "scanned-catalogs")
        tables = run_job(whole, cats, opts, provider, options, run_id, shards=n)
        merged, fold = tables["merged"], fold_length
        if options is not None:
            widths = options.select("catalog_id", F.coalesce("fold_length", F.lit(fold_length)).alias("fold_length"))
            merged, fold = spread_join(merged, widths, ["catalog_id"], by=["seq"], how="left"), "fold_length"
        for i in range(n):
            own = catalog_shard(n) == i
            rows = merged.where((F.col("shard") == i) & own).drop("shard")
            write_entries(rows, cats.where(own), out_dir, fold, opaque.where(own), codec=codec, part=(i, n))
            if not keep_merged:
                delete(spark, f"{scanned}/shard={i}")
    tables = tables | {"rejects": rejects, "merged": tables["merged"].drop("shard")}
    return tables if keep_merged else {name: t for name, t in tables.items() if name != "merged"}


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def commit_run(tables: dict[str, DataFrame], out_dir: str, run_id: str) -> None:
    """Keep a run's results and attempts, a partition per run id.

    Dynamic partition overwrite: committing a run again replaces its own partition
    only, so nothing doubles and earlier runs stay untouched.
    """
    for name in ("results", "attempts"):
        (
            tables[name].withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{out_dir.rstrip('/')}/{name}")
        )


def service_log(requests: DataFrame) -> DataFrame:
    """A recorded service's log for ``requests``: reply bodies written as files, scanned back.

    This is input data: what the service said to every request, at every try that a
    client might make. A run reads only the replies to attempts it makes.
    """
    tries = F.explode(F.sequence(F.lit(1), F.lit(att.MAX_ATTEMPTS)))
    said = pseudo_attempts(requests.withColumn("attempt", tries), F.col("attempt")).select(*LOG_COLUMNS)
    folder = scratch_folder(requests.sparkSession, "service-log", outlives=1)
    write_response_log(said, folder)
    return response_log_scan(requests.sparkSession, folder).select(*LOG_COLUMNS)


_RUNS: dict[tuple, dict[str, DataFrame]] = {}


def translate(spark: SparkSession, sf: str, opts: Options = Options()) -> dict[str, DataFrame]:
    """Run (or reuse) the whole job for ``sf`` on its service log; returns its tables by name."""
    k = _key(spark, sf, "translate") + (opts,)
    if k not in _RUNS:
        options = catalog_options(spark, sf) if opts.per_catalog else None
        ents, cats, run_id = entries(spark, sf), catalogs(spark, sf), uuid.uuid4().hex
        log = service_log(written_requests(ents, cats, opts, options, run_id))
        _RUNS[k] = run_job(ents, cats, opts, recorded_provider(log), options, run_id) | {"service_log": log}
    return _RUNS[k]
