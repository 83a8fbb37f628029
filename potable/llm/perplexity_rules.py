"""Quality rules with perplexity bands.

Model: byte 5-grams of all documents are counted in Spark, continuation counts of
the lower orders follow by aggregation. Grams and contexts are kept whole, as
integers of their bytes; estimates come from joins sharded by gram and by context,
and no model is ever held in one place. Documents are dealt to blocks, and each
block's distinct grams meet the estimates in a join (as in ``quality_classifier``).

Verdict: documents that fail the base rules (fewer than 20 words, or over 30 % of
the words in repeated 8-word windows) are out. Of the others, those whose
perplexity leaves its language's band are out. The band is laid around the bulk of
the language's documents that pass the base rules (``bands.bulk``: distinct contents,
tempered by source): ``BELOW`` half lengths of the shortest half below its mean and
``ABOVE`` above it, which on a bell curve are 5.4 and 4 deviations. So neither copies
nor junk of less than half of the weight move it past the junk. A short text's mean
is first pulled towards the bulk's mean by ``PRIOR`` bytes.

Defined results: a null or empty text has no words, fails the base rules, and its
end mark alone is scored; a null language is a language of its own; repeated rows
count as often as they occur and get equal verdicts; an empty table gives an
empty result; only id, text, language and source are read. 8-word windows are compared by
64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.llm.bands import bulk
from potable.llm.common import ship, written
from potable.llm.kneser_ney import SYMBOLS, count_grams, discounts, grams, shorter
from potable.llm.quality_classifier import estimates, perplexities, spread_join
from potable.llm.shingles import rolling, word_hashes, words_of

ORDER = 5
PRIOR = 200
#: in half lengths of the bulk's shortest half
BELOW = 8
ABOVE = 6
WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class OrderArrays:
    """One order of a model that is held in one place; the exact form that the joins are tested against."""

    keys: np.ndarray  # sorted grams
    estimate: np.ndarray  # discounted share of each gram
    contexts: np.ndarray  # sorted
    gamma: np.ndarray  # by context: what is left for the lower order


def order_arrays(keys: np.ndarray, n: np.ndarray) -> OrderArrays:
    at = np.argsort(keys)
    keys, n = keys[at], n[at].astype(np.float64)
    d = np.array([0.0, *discounts([int((n == i).sum()) for i in range(1, 5)])])[np.minimum(n, 3).astype(int)]
    contexts, context = np.unique(keys // SYMBOLS, return_inverse=True)
    total = np.bincount(context, weights=n)
    return OrderArrays(keys, (n - d) / total[context], contexts, np.bincount(context, weights=d) / total)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def log_probabilities(gram: np.ndarray, model: list[OrderArrays]) -> np.ndarray:
    p = np.full(len(gram), 1.0 / SYMBOLS)
    for k, arrays in enumerate(model, start=1):
        key = gram & ((1 << (8 * k)) - 1)
        gamma = looked_up(arrays.contexts, arrays.gamma, key >> 8, 1.0)
        p = looked_up(arrays.keys, arrays.estimate, key, 0.0) + gamma * p
    return np.log(p)


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive edges (empty ranges give 0)."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[edges[1:]] - sums[edges[:-1]]


def base_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, computed over one slice of texts at a time."""
    words, edges = words_of(texts, lower=False)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    chars = ((data & 0xC0) != 0x80) & ~_WHITE[data]
    out = {
        "n_words": np.diff(edges),
        "word_chars": per_text(chars, offsets - offsets[0]),
        "n_symbols": per_text(_SYMBOL[data], offsets - offsets[0]),
    }
    lists = pc.split_pattern(texts, "\n")
    lines, line_edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(line_edges))
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    code, owner = code[filled], owner[filled]
    repeated = pd.Series(owner * (len(lines) + 1) + code).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(owner[repeated], minlength=len(texts))

    hashes, codes, _ = word_hashes(words)
    windows = rolling(hashes[codes], WINDOW)
    text_of = np.repeat(np.arange(len(texts)), np.diff(edges))
    begins = np.flatnonzero(text_of[: len(windows)] == text_of[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    keys = pd.DataFrame({"t": text_of[begins], "w": windows[begins]})
    twice = begins[keys.duplicated(keep=False).to_numpy()]
    depth = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(depth, twice, 1)
    np.add.at(depth, twice + WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(depth)[:-1] > 0, edges)
    return out


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least_words: int = 20, most_repeated_percent: int = 30, source_col: str = "source",
) -> DataFrame:
    """(doc_id, counts, base_failed, n_bytes, perplexity, lower, upper, kept), a row per document row."""
    ship(docs.sparkSession)
    table = written(count_grams(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(True)), ORDER), "rules-grams")
    # every gram of every document was counted, so no document needs an unseen gram's estimate
    scores = estimates(table, ORDER)[-1][0].select("gram", F.log("p").alias("lp"))
    scored = written(
        perplexities(docs, scores, ORDER, id_col, text_col, lang_col, source_col, base_features, FEATURES), "rules-documents"
    )
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words")
    )
    scored = scored.withColumn("failed", failed).withColumn("raw", -F.col("lp") / F.col("n"))
    passing = scored.where("not failed")
    # a language without a passing document has its mean and no band
    means = scored.groupBy("lang").agg((-F.sum("lp") / F.sum("n")).alias("mean"))
    typical = bulk(passing, "raw").select(F.col("lang").alias("l"), "center")
    centers = means.join(typical, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "lang", F.coalesce("center", "mean").alias("target")
    )
    surprise = (-F.col("lp") + PRIOR * F.col("target")) / (F.col("n") + PRIOR)
    pulled = written(spread_join(scored, centers).withColumn("surprise", surprise).drop("target"), "rules-surprise")
    found = bulk(pulled.where("not failed"), "surprise").withColumnRenamed("lang", "l")
    bands = means.select("lang").join(found, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "lang", (F.col("center") - BELOW * F.col("half")).alias("lo"), (F.col("center") + ABOVE * F.col("half")).alias("hi"),
    )
    inside = F.coalesce(F.col("surprise").between(F.col("lo"), F.col("hi")), F.lit(False))
    return spread_join(pulled, bands).select(
        "doc_id", *FEATURES, F.col("failed").alias("base_failed"), F.col("n").alias("n_bytes"),
        F.exp("surprise").alias("perplexity"), F.exp("lo").alias("lower"), F.exp("hi").alias("upper"),
        (~F.col("failed") & inside).alias("kept"),
    )
