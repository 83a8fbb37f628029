import json
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from potable.operators.validate import validate
from potable.plans import translate as job
from potable.plans.translate import run_attempts
from potable.providers.live import check_reply, live_provider, try_again
from potable.providers.recorded import recorded_provider

ITEMS = "array<struct<pos:int,seq:bigint,msgctxt:string,msgid:string,msgid_plural:string,msgid_orig:string>>"


def _requests(spark):
    items = [(0, 1, "", "Hello", None, "Hello")]
    return spark.createDataFrame(
        [("c", 1, items, 1, None, "m", "sys", '{"translations":[{"msgid":"Hello"}]}'),
         ("c", 2, items, 1, None, "m", "sys", '{"translations":[{"msgid":"Hello"}]}')],
        f"catalog_id string, batch_no long, items {ITEMS}, n_items int, samples array<struct<plural:int,sample:int>>, "
        "model string, system_message string, payload_json string",
    )


def test_recorded_provider_replays_log(spark):
    log = spark.createDataFrame(
        [("c", 1, 1, 200, None, None, '{"translations":[{"msgid":"Hello","msgstr":"Hi"}]}'),
         ("c", 2, 1, 429, None, "rate", None)],
        "catalog_id string, batch_no long, attempt int, status int, code string, message string, content string",
    )
    out = validate(recorded_provider(log)(_requests(spark), 1)).orderBy("batch_no").collect()
    assert [(r["status"], r["error_code"], r["retryable"]) for r in out] == [(200, "OK", False), (429, "API_ERROR", True)]
    missing = recorded_provider(log)(_requests(spark), 2).select("status").distinct().collect()
    assert [r[0] for r in missing] == [599]


def test_a_restarted_run_sends_nothing_twice(spark):
    sent, down = [], [True]

    def provider(requests, attempt):
        if attempt == 3 and down:
            down.clear()
            raise RuntimeError("the driver went down")
        sent.append(attempt)
        status = F.when(F.col("batch_no") == 1, 200).otherwise(429 if attempt < 4 else 200).cast("int")
        ok = F.lit('{"translations":[{"msgid":"Hello","msgstr":"x"}]}')
        return requests.select(
            "catalog_id", "batch_no", F.lit(attempt).cast("int").alias("attempt"), status.alias("status"),
            F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"),
            F.when(status == 200, ok).alias("content"))

    run = uuid.uuid4().hex
    with pytest.raises(RuntimeError):
        run_attempts(_requests(spark), provider, run_id=run)
    log = run_attempts(_requests(spark), provider, run_id=run)
    assert sent == [1, 2, 3, 4]
    again = run_attempts(_requests(spark), provider, run_id=run)
    assert sent == [1, 2, 3, 4] and sorted((r["batch_no"], r["attempt"]) for r in again.collect()) == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4)]
    assert log.count() == 5


# ------------------------------------------------------------------ live calls


def test_one_reply_is_judged_as_the_column_ladder_does(spark):
    from tests.test_validate import CASES, ITEMS as LADDER_ITEMS, SAMPLES

    items = [(0, 1, "", "a", None, "a"), (1, 2, "c", None, "ps", "p")]
    odd = ['{"translations":[NaN,1]}', '{"translations":[1,2],"translations":[]}', "\u00a0{}", "{} {}", '"x"', "[1", "``` {} ```", "```json\n[]", "\u0085{}"]
    cases = [(status, content) for status in (200, 429, 404) for content in [*(c for c, _ in CASES), *odd]]
    df = spark.createDataFrame(
        [("cat", i, items, 2, [(0, 1), (1, 2)], status, c) for i, (status, c) in enumerate(cases)],
        f"catalog_id string, batch_no long, items {LADDER_ITEMS}, n_items int, samples {SAMPLES}, status int, content string",
    )
    rows = validate(df).orderBy("batch_no").collect()
    as_dicts = [{"msgctxt": i[2], "msgid": i[3], "msgid_plural": i[4]} for i in items]
    for r, (status, content) in zip(rows, cases):
        code = check_reply(as_dicts, 2, status, content)
        assert (code, try_again(status, code)) == (r["error_code"], r["retryable"]), (status, content)


def _chain(spark, sizes):
    """One-item batches 1..n for every catalog; the payload names catalog and batch."""
    rows = [(c, b, [(0, b, "", "Hi", None, "Hi")], 1, None, "m", "sys", json.dumps([c, b])) for c, n in sizes.items() for b in range(1, n + 1)]
    return spark.createDataFrame(
        rows, f"catalog_id string, batch_no long, items {ITEMS}, n_items int, samples array<struct<plural:int,sample:int>>, "
        "model string, system_message string, payload_json string",
    )


GOOD = '{"translations":[{"msgid":"Hi","msgstr":"x"}]}'
WRONG_ID = '{"translations":[{"msgid":"Ho","msgstr":"x"}]}'


def _service(folder, script, dies_at=None):
    """A call that notes each request in ``folder`` and answers from ``script[catalog, batch]``, try by try."""

    def call(model, system, payload):
        import os

        catalog, batch = json.loads(payload)
        if dies_at == (catalog, batch):
            os._exit(1)  # the worker is lost, and the run with it
        tries = sorted(n for n in os.listdir(folder) if n.startswith(f"{catalog}-{batch}-"))
        open(os.path.join(folder, f"{catalog}-{batch}-{len(tries) + 1}"), "x").close()
        replies = script.get((catalog, batch), [(200, GOOD)])
        status, content = replies[min(len(tries), len(replies) - 1)]
        return status, None, None, content

    return call


def _noted(folder):
    return sorted((c, int(b), int(n)) for c, b, n in (p.name.split("-") for p in folder.iterdir()))


SCRIPT = {
    ("a", 3): [(429, None), (200, WRONG_ID), (200, GOOD)],
    ("a", 20): [(500, None)],  # four times, then the catalog ends
    ("b", 1): [(401, None)],
    ("c", 40): [(200, "[]")],
    ("d", 2): [(503, None), (200, GOOD)],
}
SIZES = {"a": 60, "b": 5, "c": 45, "d": 3, "e": 40}
ENDS = {"a": 20, "b": 1, "c": 40}


def _expected():
    out = []
    for catalog, n in SIZES.items():
        for batch in range(1, min(n, ENDS.get(catalog, n)) + 1):
            replies = SCRIPT.get((catalog, batch), [(200, GOOD)])
            tries = 4 if replies == [(500, None)] else len(replies)
            out += [(catalog, batch, k + 1) for k in range(tries)]
    return sorted(out)


def _log_keys(log):
    return sorted((r["catalog_id"], r["batch_no"], r["attempt"]) for r in log.collect())


def test_no_batch_behind_a_failed_one_is_sent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "FIRST_WAVE", 2)
    monkeypatch.setattr(job, "MOST_WAVE", 16)
    waits = tmp_path / "waits"
    waits.mkdir()
    notes = tmp_path / "calls"
    notes.mkdir()

    def wait(seconds):
        (waits / uuid.uuid4().hex).write_text(str(seconds))

    requests = _chain(spark, SIZES)
    log = run_attempts(requests, live_provider(_service(str(notes), SCRIPT), wait))
    assert _noted(notes) == _expected() == _log_keys(log)
    assert Counter(float(p.read_text()) for p in waits.iterdir()) == {1.0: 3, 2.0: 2, 4.0: 1}
    # a replay of the same replies, which calls nothing, gives the same log
    said = [(c, b, k + 1, *replies[min(k, len(replies) - 1)]) for c, n in SIZES.items() for b in range(1, n + 1)
            for replies in [SCRIPT.get((c, b), [(200, GOOD)])] for k in range(4)]
    recorded = spark.createDataFrame(said, "catalog_id string, batch_no long, attempt int, status int, content string").selectExpr(
        "catalog_id", "batch_no", "attempt", "status", "string(null) code", "string(null) message", "content")
    assert _log_keys(run_attempts(requests, recorded_provider(recorded))) == _expected()


def test_a_killed_run_sends_only_what_has_no_reply(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "FIRST_WAVE", 8)
    notes = tmp_path / "calls"
    notes.mkdir()
    requests, run = _chain(spark, SIZES), uuid.uuid4().hex
    with pytest.raises(Exception):
        run_attempts(requests, live_provider(_service(str(notes), SCRIPT, dies_at=("e", 12)), lambda s: None), run_id=run)
    folder = job.run_folder(spark, f"run-{run}") + "/replies"
    published = set(_log_keys(job._published(spark, folder)))
    before = set(_noted(notes))
    assert published and published <= before and ("e", 12, 1) not in before
    fresh = tmp_path / "again"
    fresh.mkdir()
    for c, b, k in published:  # the service goes on counting tries where it was
        (fresh / f"{c}-{b}-{k}").touch()
    log = run_attempts(requests, live_provider(_service(str(fresh), SCRIPT), lambda s: None), run_id=run)
    assert _noted(fresh) == _expected() == _log_keys(log)  # "x" mode: a second call for a published try would raise
    # finished, it calls nothing any more
    assert _log_keys(run_attempts(requests, live_provider(_service(str(tmp_path / "none"), SCRIPT)), run_id=run)) == _expected()


def test_a_call_that_raises_ends_its_catalog_only(spark, tmp_path):
    def call(model, system, payload):
        if json.loads(payload) == ["a", 2]:
            raise TimeoutError("no answer")
        return 200, None, None, GOOD

    log = run_attempts(_chain(spark, {"a": 3, "b": 3}), live_provider(call)).collect()
    assert sorted((r["catalog_id"], r["batch_no"], r["status"], r["code"], r["message"]) for r in log) == [
        ("a", 1, 200, None, None), ("a", 2, 598, "TimeoutError", "no answer"),
        ("b", 1, 200, None, None), ("b", 2, 200, None, None), ("b", 3, 200, None, None)]


def test_no_request_no_call(spark):
    log = run_attempts(_chain(spark, {"a": 1}).limit(0), live_provider(lambda *a: 1 / 0))
    assert log.count() == 0


def test_a_replay_writes_each_reply_once(spark):
    from potable.operators.numbering import exists
    from potable.session import run_folder

    log = spark.createDataFrame(
        [("c", 1, 1, 200, None, None, '{"translations":[{"msgid":"Hello","msgstr":"Hi"}]}'), ("c", 2, 1, 429, None, "rate", None),
         ("c", 2, 2, 200, None, None, '{"translations":[{"msgid":"Hello","msgstr":"Hi"}]}')],
        "catalog_id string, batch_no long, attempt int, status int, code string, message string, content string",
    )
    run = uuid.uuid4().hex
    got = run_attempts(_requests(spark), recorded_provider(log), run_id=run).collect()
    assert sorted((r["batch_no"], r["attempt"], r["error_code"]) for r in got) == [(1, 1, "OK"), (2, 1, "API_ERROR"), (2, 2, "OK")]
    folder = run_folder(spark, f"run-{run}")
    assert exists(spark, f"{folder}/round-1") and not exists(spark, f"{folder}/replies-1")


def test_written_requests_hold_no_payload(spark, sf_small):
    from potable.plans.catalog import catalogs, entries
    from potable.session import run_folder

    run = uuid.uuid4().hex
    reqs = job.written_requests(entries(spark, sf_small), catalogs(spark, sf_small), job.Options(source_language="de"), None, run)
    kept = spark.read.parquet(run_folder(spark, f"run-{run}") + "/requests")
    assert "payload_json" not in kept.columns and "payload_json" in reqs.columns
    assert json.loads(reqs.first()["payload_json"])["source_language"] == "de"
