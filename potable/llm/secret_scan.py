"""Secrets in texts: fixed patterns, and two character Markov models compared by likelihood.

1. Labelled samples. Random strings are the distinct values that the fixed patterns
   find in all documents. Ordinary identifiers are the distinct runs of word
   characters in trusted documents (quality 1, not toxic) without such a value;
   ``TRAIN_DOCS`` bounds these documents, taken by the smallest hashes of their ids.
2. Models. Spark counts character trigrams of four fifths of each sample (the rest, by
   a hash, is held out). Both are order-2 Markov models over 68 characters and an end,
   each order falling back to the one below by the number of different followers
   (Witten-Bell), down to equal chances. The counts are bounded by the alphabet.
3. A string is as likely random as the better half of a mixture: the random model, or
   characters drawn evenly from the classes (lower case, capitals, digits, marks) that
   it holds. So random strings of other alphabets than those seen count as random too.
4. Candidates are whole runs of at least ``MIN_CHARS`` word characters (an
   alphanumeric next to a run, of any script, rules it out) that hold at least two of
   lower case, capitals and digits, digits or both cases among them, and touch no
   span of the patterns. A candidate is a secret if its log-likelihood ratio exceeds
   ``PRIOR``, the prior odds against secrets, and the ``QUANTILE`` of held-out ordinary
   candidates, so that an odd ordinary string in training can't open or shut the gate.

Whole texts are searched in tasks, batch by batch; nothing is shuffled but distinct
training strings and trigram counts.

Defined results: a null text is an empty one; rows of one id get a result each; rows
without an id are searched like any other (and no label trusts them); without trusted
documents or labels the ordinary model gives equal chances to all characters and only
``PRIOR`` holds; labels of one id that differ make it untrusted; spans of one kind
never overlap, and positions are code points, the end exclusive; an empty table gives
an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.llm.common import ship, written
from potable.llm.shingles import row_slices
from potable.llm.workers import over_batches

#: fixed patterns (kind, pattern, group whose length counts, least length)
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = [("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
MODEL = "model"

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
CLASSES = (26, 26, 10, 6)  # lower case, capitals, digits, marks, in the order of SYMBOLS
END = len(SYMBOLS)  # before the first and after the last character
SIZE = END + 1

TRAIN_DOCS = 20_000
MIN_CHARS = 16
LEAST_WORD = 4
PRIOR = math.log(10_000)
QUANTILE = 0.999
HELD_OUT = 5

_RUN = "[A-Za-z0-9+/_=.-]"
SPANS = "array<struct<kind: string, start: long, `end`: long, ratio: double>>"


# ------------------------------------------------------------------ models


class Markov:
    """log chances of each character after two others, from trigram counts."""

    def __init__(self, counts: np.ndarray) -> None:
        chance = np.full((SIZE, SIZE, SIZE), 1.0 / SIZE)
        for order in range(3):
            n = counts.sum(axis=tuple(range(2 - order)), keepdims=True).astype(np.float64)
            total, kinds = n.sum(axis=2, keepdims=True), (n > 0).sum(axis=2, keepdims=True)
            weight = total + kinds
            chance = np.where(weight > 0, (n + kinds * chance) / np.where(weight > 0, weight, 1), chance)
        self.log = np.log(chance).astype(np.float32)

    def score(self, codes: np.ndarray) -> float:
        at = np.concatenate([[END, END], codes, [END]])
        return float(self.log[at[:-2], at[1:-1], at[2:]].sum(dtype=np.float64))


_CODES = np.full(128, -1, dtype=np.int64)
_CODES[[ord(c) for c in SYMBOLS]] = np.arange(END)
_CLASS = np.repeat(np.arange(4), CLASSES)


def codes_of(string: str) -> np.ndarray:
    return _CODES[np.frombuffer(string.encode("ascii"), dtype=np.uint8)]


def even_score(codes: np.ndarray) -> float:
    """log chance of characters drawn evenly from the classes that the string holds."""
    present = np.unique(_CLASS[codes])
    return -len(codes) * math.log(sum(CLASSES[c] for c in present)) - math.log(1 << len(CLASSES))


def log_ratio(random: Markov, ordinary: Markov, string: str) -> float:
    codes = codes_of(string)
    either = np.logaddexp(random.score(codes), even_score(codes)) - math.log(2)
    return float(either) - ordinary.score(codes)


# ------------------------------------------------------------------ searching one text


def pattern_spans(text: str, compiled: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all matches that are long enough."""
    found = []
    for number, (_, pattern, group, least) in enumerate(compiled):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def compiled_patterns() -> list[tuple[str, re.Pattern, int, int]]:
    """The hex pattern asks for its least length at once: shorter runs would only be dropped."""
    out = []
    for kind, pattern, group, least in PATTERNS:
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        out.append((kind, re.compile(pattern.replace("]+", f"]{{{least},}}") if kind == "hex" else pattern, flags), group, least))
    return out


def is_candidate(run: str) -> bool:
    lower, upper, digit = (re.search(c, run) is not None for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return len(run) >= MIN_CHARS and ((digit and (lower or upper)) or (lower and upper))


def candidate_spans(text: str, runs: re.Pattern, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Whole runs that could be secrets and touch no taken span."""
    at, taken = 0, sorted((a, b) for a, _, b in taken)
    reach = 0  # end of the taken spans that start before the run's end
    for m in runs.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach > a or not is_candidate(m.group()):
            continue
        if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
            continue
        yield a, b


# ------------------------------------------------------------------ training


def _values(text: Column) -> Column:
    """Values that the patterns find (the same matches as in ``pattern_spans``)."""
    out = []
    for kind, pattern, group, least in PATTERNS:
        java = f"(?i){pattern}" if kind == "assign" else pattern
        found = F.regexp_extract_all(text, F.lit(java), F.lit(group))
        out.append(F.filter(found, lambda v: F.length(v) >= least))  # noqa: B023
    return F.concat(*out)


def labelled_strings(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ordinary, string): the distinct labelled samples."""
    trusted = (
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
        .where("good").orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS).select("id")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    random = rows.select(F.explode(F.array_distinct(_values(F.col("text")))).alias("string")).where(
        F.length("string") >= MIN_CHARS
    )
    plain = rows.join(F.broadcast(trusted), "id", "left_semi").where(F.size(_values(F.col("text"))) == 0)
    runs = F.regexp_extract_all("text", F.lit(f"{_RUN}{{{LEAST_WORD},}}"), F.lit(0))
    ordinary = plain.select(F.explode(F.array_distinct(runs)).alias("string"))
    both = random.select(F.lit(False).alias("ordinary"), "string").unionByName(ordinary.select(F.lit(True).alias("ordinary"), "string"))
    return both.distinct()


def trigram_counts(strings: DataFrame) -> DataFrame:
    """(ordinary, gram, n) with gram = ((a * SIZE) + b) * SIZE + c."""

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE, SIZE, SIZE), dtype=np.int64)
        for batch in batches:
            for ordinary, string in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.concatenate([[END, END], codes_of(string), [END]])
                np.add.at(counts[int(ordinary)], (at[:-2], at[1:-1], at[2:]), 1)
        kind, gram = np.nonzero(counts.reshape(2, -1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind == 1), pa.array(gram, pa.int32()), pa.array(counts.reshape(2, -1)[kind, gram])], ["ordinary", "gram", "n"]
        )

    return strings.mapInArrow(run, "ordinary boolean, gram int, n long").groupBy("ordinary", "gram").agg(F.sum("n").alias("n"))


class SecretModel:
    """Both models and the ratio above which a candidate is a secret."""

    def __init__(self, counts: dict[bool, dict[int, int]], threshold: float = PRIOR) -> None:
        tables = []
        for ordinary in (False, True):
            table = np.zeros(SIZE**3, dtype=np.int64)
            grams = counts.get(ordinary, {})
            table[list(grams)] = list(grams.values())
            tables.append(Markov(table.reshape(SIZE, SIZE, SIZE)))
        self.random, self.ordinary = tables
        self.threshold = threshold

    def ratio(self, string: str) -> float:
        return log_ratio(self.random, self.ordinary, string)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    """Models from the samples, and the threshold from held-out ordinary candidates.

    The driver holds trigram counts (at most 2 * 69**3) and one quantile.
    """
    spark = docs.sparkSession
    ship(spark)
    strings = written(labelled_strings(docs, labels, id_col, text_col), "secret-samples")
    held_out = F.pmod(F.xxhash64("string"), F.lit(HELD_OUT)) == 0
    counts: dict[bool, dict[int, int]] = {}
    for row in trigram_counts(strings.where(~held_out).select("ordinary", "string")).collect():
        counts.setdefault(row["ordinary"], {})[row["gram"]] = row["n"]
    model = SecretModel(counts)
    shared = spark.sparkContext.broadcast(model)

    @over_batches
    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [shared.value.ratio(s) for s in batch.column(0).to_pylist() if is_candidate(s)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.float64())], ["ratio"])

    held = strings.where(held_out & F.col("ordinary") & (F.length("string") >= MIN_CHARS)).select("string")
    cut = held.mapInArrow(ratios, "ratio double").agg(F.percentile_approx("ratio", QUANTILE, 10_000).alias("q")).first()["q"]
    model.threshold = max(PRIOR, cut if cut is not None else PRIOR)
    return model


# ------------------------------------------------------------------ operator


def find_secrets(
    docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, secrets) of every row: spans by start, then kind; ``ratio`` only where the models decided."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])
    kinds = [kind for kind, *_ in PATTERNS]

    @over_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, patterns, runs = shared.value, compiled_patterns(), re.compile(f"{_RUN}{{{MIN_CHARS},}}")
        for batch in batches:
            for at, part in row_slices(batch.column(1)):
                out = []
                for text in part.to_pylist():
                    base = pattern_spans(text, patterns)
                    spans = [(a, n, {"kind": kinds[n], "start": a, "end": b, "ratio": None}) for a, n, b in base]
                    for a, b in candidate_spans(text, runs, base):
                        ratio = own.ratio(text[a:b])
                        if ratio > own.threshold:
                            spans.append((a, len(kinds), {"kind": MODEL, "start": a, "end": b, "ratio": ratio}))
                    out.append([s for *_, s in sorted(spans, key=lambda s: s[:2])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(out, pa.list_(span))], ["doc_id", "secrets"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, secrets {SPANS}")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per pattern, a digest of the patterns' spans and all spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != MODEL)
    return found.select(
        "doc_id", *[n(kind) for kind, *_ in PATTERNS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"),
    )
