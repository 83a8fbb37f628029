import json

import pytest
from pyspark.sql import functions as F

from potable.operators.validate import align_response, strip_json_fences, validate

ITEMS = "array<struct<pos:int,seq:bigint,msgctxt:string,msgid:string,msgid_plural:string,msgid_orig:string>>"
SAMPLES = "array<struct<plural:int,sample:int>>"

S = {"msgid": "a", "msgstr": "A"}
P = {"msgid_plural": "ps", "msgctxt": "c", "msgstr": ["x", "y"]}


def T(*xs):
    return json.dumps({"translations": list(xs)})


def with_(d, **kw):
    out = dict(d)
    for k, v in kw.items():
        if v is KeyError:
            out.pop(k, None)
        else:
            out[k] = v
    return out


CASES = [
    (T(S, P), "OK"),
    (T(with_(S, msgctxt=""), P), "OK"),
    ("```json\n" + T(S, P) + "\n```", "OK"),
    (None, "EMPTY"),
    (" \n", "EMPTY"),
    ("nope", "NOT_JSON"),
    ("[]", "NO_TRANSLATIONS"),
    ("1", "NO_TRANSLATIONS"),
    ('{"x":1}', "NO_TRANSLATIONS"),
    (T(S, P) + " and more", "NOT_JSON"),
    ("{} {}", "NOT_JSON"),
    ("1, 2", "NOT_JSON"),
    ("1], [2", "NOT_JSON"),
    ("null", "NO_TRANSLATIONS"),
    ('{"translations":{}}', "TRANSLATIONS_NOT_ARRAY"),
    ('{"translations":null}', "TRANSLATIONS_NOT_ARRAY"),
    (T(S), "COUNT_MISMATCH"),
    (T(with_(S, msgstr=KeyError), P), "MISSING_MSGSTR"),
    (T(None, P), "MISSING_MSGSTR"),
    (T(S, with_(P, msgctxt=KeyError)), "CTX_MISMATCH"),
    (T(with_(S, msgid="b"), P), "ID_MISMATCH"),
    (T(with_(S, msgid_plural=None), P), "UNEXPECTED_PLURAL"),
    (T(with_(S, msgstr=None), P), "MSGSTR_NOT_STRING"),
    (T(with_(S, msgstr=["A"]), P), "MSGSTR_NOT_STRING"),
    (T(S, with_(P, msgid_plural="q")), "PLURAL_MISMATCH"),
    (T(S, with_(P, msgid="p")), "UNEXPECTED_MSGID"),
    (T(S, with_(P, msgstr=["x"])), "PLURAL_LENGTH"),
    (T(S, with_(P, msgstr=[])), "PLURAL_LENGTH"),
    (T(S, with_(P, msgstr=["x", 1])), "MSGSTR_NOT_STRING_ARRAY"),
    (T(S, with_(P, msgstr="x")), "MSGSTR_NOT_STRING_ARRAY"),
    (T(with_(S, msgid="b"), with_(P, msgid_plural="q", msgstr=KeyError)), "ID_MISMATCH"),
]


@pytest.fixture(scope="module")
def validated(spark):
    items = [(0, 1, "", "a", None, "a"), (1, 2, "c", None, "ps", "p")]
    rows = [("cat", i, items, 2, [(0, 1), (1, 2)], 200, c) for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(
        rows, f"catalog_id string, batch_no long, items {ITEMS}, n_items int, samples {SAMPLES}, status int, content string"
    ).withColumn("attempt", F.lit(1))
    return validate(df).orderBy("batch_no").collect()


def test_ladder(validated):
    got = [r["error_code"] for r in validated]
    assert got == [c for _, c in CASES]


def test_first_position_wins_and_retry_class(validated):
    last = validated[-1]
    assert last["error_pos"] == 0 and last["retryable"] is True
    by_code = {r["error_code"]: r["retryable"] for r in validated}
    assert by_code["MISSING_MSGSTR"] is False and by_code["CTX_MISMATCH"] is True


def test_duplicate_keys_divergence(spark):
    # JSON.parse keeps the last key; Spark's parser rejects the document (documented)
    df = spark.createDataFrame([('{"translations":[{"msgid":"z","msgid":"a","msgstr":"A"}]}',)], "content string")
    v = df.select(F.try_parse_json(strip_json_fences("content")).isNull().alias("rejected")).first()
    assert v["rejected"] is True


def test_api_errors_retry_class(spark):
    items = [(0, 1, "", "a", None, "a")]
    rows = [("cat", i, items, 1, None, st, None) for i, st in enumerate([429, 500, 503, 401, 403, 400, 404])]
    df = spark.createDataFrame(
        rows, f"catalog_id string, batch_no long, items {ITEMS}, n_items int, samples {SAMPLES}, status int, content string"
    )
    got = [(r["error_code"], r["retryable"]) for r in validate(df).orderBy("batch_no").collect()]
    assert got == [("API_ERROR", True)] * 3 + [("API_ERROR", False)] * 4


def test_align_and_coerce(spark, validated):
    items = [(0, 1, "", "a", None, "a"), (1, 2, "c", None, "ps", "p")]
    df = spark.createDataFrame(
        [("cat", 0, items, 2, [(0, 1), (1, 2)], 200, T(S, P))],
        f"catalog_id string, batch_no long, items {ITEMS}, n_items int, samples {SAMPLES}, status int, content string",
    )
    rows = align_response(validate(df)).orderBy("pos").collect()
    assert [(r["msgid"], r["msgctxt"], r["msgstr"]) for r in rows] == [("a", "", ["A"]), ("p", "c", ["x", "y"])]


def test_plural_identity_is_positional(spark):
    # T8: two plurals with the same msgid_plural produce identical request items;
    # only the position tells which entry each answer belongs to
    items = [(0, 1, "", None, "items", "one item"), (1, 2, "", None, "items", "an item")]
    reply = T({"msgid_plural": "items", "msgstr": ["a", "b"]}, {"msgid_plural": "items", "msgstr": ["c", "d"]})
    df = spark.createDataFrame(
        [("cat", 0, items, 2, None, 200, reply)],
        f"catalog_id string, batch_no long, items {ITEMS}, n_items int, samples {SAMPLES}, status int, content string",
    )
    rows = align_response(validate(df)).orderBy("pos").collect()
    assert [(r["msgid"], r["msgstr"]) for r in rows] == [("one item", ["a", "b"]), ("an item", ["c", "d"])]
