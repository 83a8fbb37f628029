from potable.operators.attempts import backoff_ms, classify_api_error, committed_prefix, resolve_attempts

# (batch, attempt, error_code, retryable)
SEQUENCES = {
    1: [("OK", False)],
    2: [("API_ERROR", True), ("OK", False)],
    3: [("API_ERROR", True), ("API_ERROR", True), ("API_ERROR", True), ("OK", False)],
    4: [("API_ERROR", True)] * 4,
    5: [("API_ERROR", False)],
    6: [("ID_MISMATCH", True), ("OK", False)],
    7: [("NOT_JSON", False)],
    8: [("OK", False), ("OK", False)],  # attempt 2 after a terminal attempt 1: invalid
}


def test_resolve_attempts(spark):
    rows = [("c", b, a + 1, code, retry) for b, seq in SEQUENCES.items() for a, (code, retry) in enumerate(seq)]
    df = spark.createDataFrame(rows, "catalog_id string, batch_no long, attempt int, error_code string, retryable boolean")
    got = {r["batch_no"]: (r["final_attempt"], r["outcome"], r["n_invalid"]) for r in resolve_attempts(df).collect()}
    assert got == {
        1: (1, "succeeded", 0),
        2: (2, "succeeded", 0),
        3: (4, "succeeded", 0),
        4: (4, "failed", 0),
        5: (1, "failed", 0),
        6: (2, "succeeded", 0),
        7: (1, "failed", 0),
        8: (1, "succeeded", 1),
    }


def test_committed_prefix_stops_at_first_failure(spark):
    df = spark.createDataFrame(
        [("a", 1, "succeeded"), ("a", 2, "failed"), ("a", 3, "succeeded"), ("b", 1, "succeeded")],
        "catalog_id string, batch_no long, outcome string",
    )
    got = {(r["catalog_id"], r["batch_no"]): r["committed"] for r in committed_prefix(df).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 1): True}


def test_classify_and_backoff(spark):
    rows = [
        (401, None, "x"), (403, None, "x"), (429, "insufficient_quota", "x"), (429, None, "You exceeded your QUOTA"),
        (429, None, "slow down"), (400, None, "bad response_format"), (400, None, "nope"), (500, None, ""),
        (503, None, ""), (418, None, ""), (200, None, None),
    ]
    df = spark.createDataFrame(rows, "status int, code string, message string")
    got = [r[0] for r in df.select(classify_api_error()).collect()]
    assert got == [
        "invalid_api_key", "region_unsupported", "quota_exceeded", "quota_exceeded", "rate_limited",
        "schema_unsupported", "invalid_request", "server_error", "overloaded", "generic", None,
    ]
    b = spark.createDataFrame([(1,), (2,), (3,), (4,)], "attempt int").select(backoff_ms()).collect()
    assert [r[0] for r in b] == [1000, 2000, 4000, None]
