"""Quality classifier: per-document perplexity under a Kneser-Ney model of trusted text.

Training text: all documents with a label ``quality = 1`` and ``toxic = 0`` and an even
hash (their ids are a written table, which Spark broadcasts to the counting scan only
while it is small). Counts, continuation counts and context totals are Spark tables; the
estimates of all seen grams come from joins sharded by gram and by context, and no
model is ever held in one place.

Scoring: the grams of all documents are listed by the counting scan and get their
estimates. Documents are dealt to blocks by a hash of their content; each block's
distinct grams meet the estimates in a join, and come back to their block, where
every document's logarithms are summed. So the join's rows are distinct grams per
block, not positions.

Verdict: a document's mean log probability is pulled by ``PRIOR`` bytes towards the
center of the trusted documents with an odd hash (which the model has not seen) of its
language (a short text says little). Center and half length come from ``bands.bulk``;
with ``k`` such documents they count ``k / (k + OWN_WORTH)``, and the rest is the
language's own distribution, so a language without labels is judged against itself
and nothing jumps as labels grow. The perplexity must lie between two cuts, in half
lengths from the center, which held-out labels choose: bad (quality 0) against trusted
documents, where a share of clean ones costs ``CLEAN_COST`` times as much. A language's
labels are mixed with ``OWN_WORTH`` labels spread as all languages' are, and its cuts
with the wide default ones, which count as ``DEFAULT_WORTH`` labels. Trusted
documents are kept whatever their score.

Defined results: a null or empty text is its end mark alone; a null language is a
language of its own; a null id is scored and judged like any other; repeated rows
get equal verdicts; with no trusted text at all, everything is kept with a null
perplexity; an empty table gives an empty result; labels of one document that
disagree make it untrusted (any quality 0: bad). Only id, text, language and source
are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.llm.bands import LEAST_HALF, bulk
from potable.llm.common import ship, total_text_bytes, written
from potable.llm.kneser_ney import SYMBOLS, count_grams, discounts, shorter, text_grams
from potable.llm.shingles import row_slices
from potable.llm.workers import over_group, over_pair

ORDER = 4
#: text bytes of a scoring block
BLOCK_BYTES = 24 << 20
PRIOR = 200
#: documents (or labels) that a language's own distribution (or all languages' labels) counts for beside its own
OWN_WORTH = 50
#: steps a half length, steps to either side, and the tightest cut
PER_HALF, STEPS, LEAST_CUT = 4, 64, 2.5
#: a share of the clean labelled documents is worth so many times that share of the bad ones
CLEAN_COST = 20
#: cuts without labels, in half lengths, and the labels of a language that they count for beside its own
DEFAULT_BELOW, DEFAULT_ABOVE, DEFAULT_WORTH = 8.0, 6.0, 10


def estimates(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1: (gram, p) of seen grams and (context, gamma), as written tables."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = written(shorter(tables[k + 1], k), f"kn-counts-{k}")
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        table = tables[k].withColumn("context", F.shiftright("gram", 8))
        row = table.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
        d = discounts([row[f"n{i}"] for i in range(1, 5)])
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(F.lit(d[2]))
        contexts = written(
            table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
            .select("context", "total", (F.col("freed") / F.col("total")).alias("gamma")),
            f"kn-contexts-{k}",
        )
        own = table.join(contexts, "context").select("gram", ((F.col("n") - discount) / F.col("total")).alias("a"), "gamma")
        if k == 1:
            seen = own.select("gram", (F.col("a") + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            lower = out[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))
            seen = own.withColumn("suffix", suffix).join(lower, "suffix").select("gram", (F.col("a") + F.col("gamma") * F.col("q")).alias("p"))
        out.append((written(seen, f"kn-p-{k}"), contexts.select("context", "gamma")))
    return out


def gram_scores(events: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, lp): log probability of each distinct gram, backing off through the orders by joins."""
    order = len(model)
    rows = events.withColumn("p", F.lit(1.0 / SYMBOLS))
    gamma_unseen = F.lit(1.0)
    for k, (seen, contexts) in enumerate(model, start=1):
        key = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)) if k < order else F.col("gram")
        rows = (
            rows.withColumn("key", key).withColumn("ctx", F.shiftright("key", 8))
            .join(seen.select(F.col("gram").alias("key"), F.col("p").alias("found")), "key", "left")
            .join(contexts.select(F.col("context").alias("ctx"), "gamma"), "ctx", "left")
            .select("gram", F.coalesce("found", F.coalesce("gamma", gamma_unseen) * F.col("p")).alias("p"))
        )
    return rows.select("gram", F.log("p").alias("lp"))


def perplexities(
    docs: DataFrame, scores: DataFrame, order: int, id_col: str, text_col: str, lang_col: str, source_col: str,
    features: Callable[[pa.Array], dict[str, np.ndarray]] | None = None, names: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, lang, source, content, n, lp, *names): predicted bytes, their summed log probability and counts of every row."""
    blocks = max(1, -(-total_text_bytes(docs, text_col) // BLOCK_BYTES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("content"), text.alias("text"),
    ).repartition(blocks, "block")

    @over_group
    def distinct(table: pa.Table) -> pa.Table:
        held = np.zeros(0, dtype=np.int64)
        for part in table.column("text").chunks:
            for _, codes, _ in text_grams(part, order):
                held = np.union1d(held, codes)
        block = np.full(len(held), table.column("block")[0].as_py(), dtype=np.int32)
        return pa.table({"block": block, "gram": held})

    @over_pair
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order_of = np.argsort(right.column("gram").to_numpy())
        known = right.column("gram").to_numpy()[order_of]
        value = right.column("lp").to_numpy()[order_of]
        n, lp, counts = [np.zeros(0, np.int64)], [np.zeros(0)], {c: [np.zeros(0, np.int64)] for c in names}
        for part in left.column("text").chunks:
            for _, codes, first in text_grams(part, order):
                code, found = pd.factorize(codes)
                each = value[np.searchsorted(known, found)][code]
                lp.append(np.add.reduceat(each, first[:-1]))
                n.append(np.diff(first))
            for _, some in row_slices(part) if features else ():
                own = features(pa.concat_arrays([some]))
                for c in names:
                    counts[c].append(own[c].astype(np.int64))
        return pa.table({
            **{c: left.column(c) for c in ("doc_id", "lang", "source", "content")},
            "n": np.concatenate(n), "lp": np.concatenate(lp), **{c: np.concatenate(counts[c]) for c in names},
        })

    # both branches read the same shuffled texts (the exchange is reused)
    back = rows.groupBy("block").applyInArrow(distinct, "block int, gram long").join(scores, "gram").select("block", "gram", "lp")
    schema = ["doc_id long, lang string, source string, content long, n long, lp double", *(f"{c} long" for c in names)]
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, ", ".join(schema))


def classify_quality(
    docs: DataFrame, labels: DataFrame,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, lower, threshold, trusted, kept), a row per document row."""
    ship(docs.sparkSession)
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))
    labelled = (
        labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .where("id is not null and (q = 0 or (q = 1 and t = 0))").select("id", (F.col("q") == 1).alias("clean"), half.alias("half"))
    )
    labelled = written(labelled, "labelled-ids")
    train = written(labelled.where("clean and half = 0").select(F.col("id").alias("train_id")), "train-ids")
    flagged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        train, F.col("id") == F.col("train_id"), "left"
    )
    grams = written(count_grams(flagged.select("text", F.col("train_id").isNotNull().alias("counted")), ORDER), "kn-grams")
    counts = grams.where("n > 0")
    if counts.isEmpty():
        return docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
            *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "lower", "threshold")],
            F.lit(False).alias("trusted"), F.lit(True).alias("kept"),
        )
    scores = written(gram_scores(grams.select("gram"), estimates(counts, ORDER)), "kn-scores")
    scored = written(perplexities(docs, scores, ORDER, id_col, text_col, lang_col, source_col), "kn-documents")
    flags = labelled.select(
        F.col("id").alias("tid"), F.col("clean").alias("trusted"), (F.col("clean") & (F.col("half") == 1)).alias("unseen"),
        (~F.col("clean")).alias("bad"),
    )
    scored = scored.join(flags, F.col("doc_id") == F.col("tid"), "left").drop("tid")
    for c in ("trusted", "unseen", "bad"):
        scored = scored.withColumn(c, F.coalesce(c, F.lit(False)))
    scored = scored.withColumn("raw", -F.col("lp") / F.col("n"))
    # one row per language; salted copies spread a language that holds most rows
    pulled = spread_join(scored, written(typical(scored, "raw").select("lang", "center"), "kn-raw-centers"))
    surprise = (-F.col("lp") + PRIOR * F.col("center")) / (F.col("n") + PRIOR)
    pulled = written(pulled.withColumn("surprise", surprise).drop("raw", "lp", "center"), "kn-perplexities")
    # one row per language each: written, so that no plan holds the aggregates of another
    placed = spread_join(pulled, written(typical(pulled, "surprise"), "kn-centers"))
    cuts = written(label_cuts(placed), "kn-cuts")
    bands = cuts.select(
        "lang", F.exp(F.col("center") + F.col("lo") * F.col("half")).alias("lower"),
        F.exp(F.col("center") + F.col("hi") * F.col("half")).alias("threshold"),
    )
    perplexity = F.exp("surprise")
    return spread_join(pulled, bands).select(
        "doc_id", "lang", F.col("n").alias("n_bytes"), perplexity.alias("perplexity"), "lower", "threshold", "trusted",
        (F.col("trusted") | perplexity.between(F.col("lower"), F.col("threshold"))).alias("kept"),
    )


def typical(rows: DataFrame, value: str) -> DataFrame:
    """(lang, center, half): of the held-out trusted documents, mixed with the language's own as long as those are few."""
    out = rows.groupBy("lang").agg(F.avg(value).alias("mean"))
    for name, part in (("own", rows.where("not bad and (unseen or not trusted)")), ("held", rows.where("unseen"))):
        found = bulk(part, value).toDF(f"{name}_lang", f"{name}_center", f"{name}_half", f"{name}_docs")
        found = written(found, f"kn-{name}-bulk")
        out = out.join(found, F.col("lang").eqNullSafe(F.col(f"{name}_lang")), "left")
    docs = F.coalesce("held_docs", F.lit(0))
    share = docs / (docs + OWN_WORTH)

    def mixed(c: str, otherwise: Column) -> Column:
        return (share * F.coalesce(f"held_{c}", F.lit(0.0)) + (1 - share) * F.coalesce(F.col(f"own_{c}"), otherwise)).alias(c)

    return out.select("lang", mixed("center", F.col("mean")), mixed("half", F.lit(LEAST_HALF)))


def best_cuts(bad: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Cuts in half lengths below and above, from shares of bad and clean documents per step."""
    found = []
    for b, c in ((bad[::-1], clean[::-1]), (bad, clean)):
        least = int(LEAST_CUT * PER_HALF)
        gain = np.array([(b[STEPS + e :] - CLEAN_COST * c[STEPS + e :]).sum() for e in range(least, STEPS + 1)])
        best = np.flatnonzero(gain >= gain.max() - 1e-9)
        e = least + int(best[len(best) // 2])
        found.append(e / PER_HALF)
    return -found[0], found[1]


def label_cuts(placed: DataFrame) -> DataFrame:
    """(lang, center, half, lo, hi): cuts that held-out labels choose; a language of few labels goes by those of all."""
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS - 1), F.floor((F.col("surprise") - F.col("center")) / F.col("half") * PER_HALF)))
    once = placed.where("bad or unseen").groupBy("lang", "content").agg(F.max("bad").alias("bad"), F.min(step).alias("step"))
    steps = written(
        once.groupBy("lang", "step").agg(F.sum(F.col("bad").cast("long")).alias("b"), F.sum((~F.col("bad")).cast("long")).alias("c")),
        "kn-label-steps",
    )
    both = np.zeros((2, 2 * STEPS))
    for r in steps.groupBy("step").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect():
        both[:, r["step"] + STEPS] = r["b"], r["c"]
    langs = placed.groupBy("lang").agg(F.first("center").alias("center"), F.first("half").alias("half"))
    if not both.sum(axis=1).all():
        return langs.withColumn("lo", F.lit(-DEFAULT_BELOW)).withColumn("hi", F.lit(DEFAULT_ABOVE))
    pooled = both / both.sum(axis=1, keepdims=True)

    @over_group
    def choose(table: pa.Table) -> pa.Table:
        own = np.zeros((2, 2 * STEPS))
        own[:, table.column("step").to_numpy() + STEPS] = table.column("b").to_numpy(), table.column("c").to_numpy()
        shares = (own + OWN_WORTH * pooled) / (own.sum(axis=1, keepdims=True) + OWN_WORTH)
        lo, hi = best_cuts(*shares)
        share = own.sum() / (own.sum() + DEFAULT_WORTH)
        lo, hi = share * lo - (1 - share) * DEFAULT_BELOW, share * hi + (1 - share) * DEFAULT_ABOVE
        return pa.table({"l": table.column("lang").slice(0, 1), "lo": [lo], "hi": [hi]})

    own = steps.groupBy("lang").applyInArrow(choose, "l string, lo double, hi double")
    return langs.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "lang", "center", "half", F.coalesce("lo", F.lit(-DEFAULT_BELOW)).alias("lo"), F.coalesce("hi", F.lit(DEFAULT_ABOVE)).alias("hi")
    )


SALTS = 32


def spread_join(rows: DataFrame, by_lang: DataFrame) -> DataFrame:
    """``rows`` with the columns of their language's row; each language is dealt over several keys."""
    salted = by_lang.withColumnRenamed("lang", "__lang").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALTS)).cast("int")
    return rows.withColumn("__own", own).join(
        salted, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("__own") == F.col("__salt"))
    ).drop("__lang", "__salt", "__own")
