"""Live calls, a catalog's batches one after another.

A catalog is translated batch by batch, and its first failed batch ends it: what lies
behind is never sent. So a catalog's requests form a chain. ``call_in_order`` gives each
chain to one task, which streams through it in batch order: it calls, waits before
a retry, and stops the chain at the first batch that fails for good. Catalogs run
side by side.

Whether a reply is good, worth another try or final must be known before the next call,
so ``check_reply`` applies the reply contract to one reply inside the task. It
only steers the calls: the verdicts that count are those of ``operators/validate`` on
the written replies (``tests/test_providers.py`` holds the two against each other).
"""

from __future__ import annotations

import json
import re
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.functions.text import JS_WS_CLASS
from potable.operators.attempts import MAX_ATTEMPTS, RETRY_DELAYS_MS
from potable.operators.validate import RETRYABLE_CODES, RETRYABLE_STATUS

# tasks run this module's functions; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLY_SCHEMA = "catalog_id string, batch_no long, attempt int, status int, code string, message string, content string"
ANSWER = "array<struct<attempt: int, status: int, code: string, message: string, content: string>>"
#: status of a call that raised; it is not retryable by itself
CALL_FAILED = 598

Answer = tuple[int, str | None, str | None, str | None]  # status, code, message, content


@dataclass(frozen=True)
class LiveCalls:
    """``call(model, system_message, payload_json)`` gives status, code, message and content.

    The caller supplies the client and its credentials; nothing here opens a
    connection. A call that raises becomes a reply with status ``CALL_FAILED``.
    """

    call: Callable[[str, str, str], Answer]
    wait: Callable[[float], None] = time.sleep


def live_provider(call: Callable[[str, str, str], Answer], wait: Callable[[float], None] = time.sleep) -> LiveCalls:
    return LiveCalls(call, wait)


# ------------------------------------------------------------------ one reply


class _Unusable(ValueError):
    pass


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Unusable("a key occurs twice")
    return out


def _no_constant(name: str) -> None:
    raise _Unusable(name)


def _stripped(content: str) -> str:
    space = f"{JS_WS_CLASS}+"
    text = re.sub(rf"\A{space}|{space}\Z", "", content)
    fenced = re.fullmatch(rf"```(?:json)?{JS_WS_CLASS}*\n?(.*?)\n?```{JS_WS_CLASS}*", text, re.DOTALL)
    return re.sub(rf"\A{space}|{space}\Z", "", fenced.group(1)) if fenced else text


def _entry_fault(item: dict, entry: object, n_samples: int) -> str | None:
    if not isinstance(entry, dict) or "msgstr" not in entry:
        return "MISSING_MSGSTR"
    context, text = entry.get("msgctxt"), entry["msgstr"]
    if (context if isinstance(context, str) else "") != (item["msgctxt"] or ""):
        return "CTX_MISMATCH"
    if item["msgid"] is not None:
        if entry.get("msgid") != item["msgid"]:
            return "ID_MISMATCH"
        if "msgid_plural" in entry:
            return "UNEXPECTED_PLURAL"
        return None if isinstance(text, str) else "MSGSTR_NOT_STRING"
    if entry.get("msgid_plural") != item["msgid_plural"]:
        return "PLURAL_MISMATCH"
    if "msgid" in entry:
        return "UNEXPECTED_MSGID"
    if not isinstance(text, list) or not all(isinstance(form, str) for form in text):
        return "MSGSTR_NOT_STRING_ARRAY"
    return "PLURAL_LENGTH" if n_samples and len(text) != n_samples else None


def check_reply(items: list[dict], n_samples: int, status: int, content: str | None) -> str:
    """Code of the first rule that the reply breaks, or ``OK``."""
    if status != 200:
        return "API_ERROR"
    text = _stripped(content or "")
    if not text:
        return "EMPTY"
    try:
        reply = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return "NOT_JSON"
    if not isinstance(reply, dict) or "translations" not in reply:
        return "NO_TRANSLATIONS"
    entries = reply["translations"]
    if not isinstance(entries, list):
        return "TRANSLATIONS_NOT_ARRAY"
    if len(entries) != len(items):
        return "COUNT_MISMATCH"
    return next((f for f in (_entry_fault(i, e, n_samples) for i, e in zip(items, entries, strict=True)) if f), "OK")


def try_again(status: int, fault: str) -> bool:
    return status in RETRYABLE_STATUS or fault in RETRYABLE_CODES


# ------------------------------------------------------------------ chains of calls


def _ask(live: LiveCalls, row: dict) -> Answer:
    try:
        return live.call(row["model"], row["system_message"], row["payload_json"])
    except Exception as error:  # noqa: BLE001
        return CALL_FAILED, type(error).__name__, str(error), None


def _batch_calls(live: LiveCalls, row: dict) -> tuple[list[tuple[int, Answer]], bool]:
    """(new replies of one batch by attempt, whether it succeeded); answered attempts aren't sent again."""
    known = {a["attempt"]: (a["status"], a["code"], a["message"], a["content"]) for a in row["answered"] or []}
    sent = []
    for attempt in range(1, MAX_ATTEMPTS + 1):
        answer = known.get(attempt)
        if answer is None:
            if attempt > 1:
                live.wait(RETRY_DELAYS_MS[attempt - 2] / 1000)
            answer = _ask(live, row)
            sent.append((attempt, answer))
        status, _, _, content = answer
        fault = check_reply(row["items"], row["n_samples"], status, content)
        if fault == "OK":
            return sent, True
        if not try_again(status, fault):
            break
    return sent, False


def call_in_order(requests: DataFrame, live: LiveCalls) -> DataFrame:
    """New replies for ``requests`` (with ``answered``, the replies they already have).

    A task holds one batch at a time; the requests of a catalog follow each other in
    one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog, ended = None, False
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                if row["catalog_id"] != catalog:
                    catalog, ended = row["catalog_id"], False
                if ended:
                    continue
                sent, good = _batch_calls(live, row)
                ended = not good
                rows += [(catalog, row["batch_no"], attempt, *answer) for attempt, answer in sent]
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["catalog_id", "batch_no", "attempt", "status", "code", "message", "content"],
            )

    needed = requests.select(
        "catalog_id", "batch_no", F.transform("items", lambda i: F.struct(i["msgctxt"].alias("msgctxt"), i["msgid"].alias("msgid"),
                                                                          i["msgid_plural"].alias("msgid_plural"))).alias("items"),
        F.coalesce(F.size("samples"), F.lit(0)).alias("n_samples"), "model", "system_message", "payload_json",
        F.col("answered").cast(ANSWER).alias("answered"),
    )
    chains = needed.repartition("catalog_id").sortWithinPartitions("catalog_id", "batch_no")
    return chains.mapInArrow(run, REPLY_SCHEMA)
