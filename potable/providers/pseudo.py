"""A service's replies for recorded logs, made of column expressions.

``pseudo_attempts(requests, attempt)`` answers every request of one round
without leaving the JVM: the reply (or API error) is chosen by arithmetic on
the catalog, batch number and attempt, and covers every outcome of the reply
contract — API errors of each status, fenced and plain JSON, empty and
malformed replies, each entry-level violation, and valid replies whose text
drops placeholders. The same rules are written in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# what decides a reply; with these numbers every outcome occurs in runs over small tables too
N_MODES = 89
BY_CATALOG, BY_BATCH, BY_ATTEMPT = 19, 13, 3

# API error replies by mode 0..8 (status, code, message).
API_ERRORS = [
    (429, None, "Rate limit reached for requests"),
    (429, "insufficient_quota", "You exceeded your current quota, please check your plan"),
    (500, None, "The server had an error while processing your request"),
    (503, None, "The engine is currently overloaded, please try again later"),
    (401, None, "Incorrect API key provided"),
    (403, None, "Country, region, or territory not supported"),
    (400, None, "Invalid schema for response_format 'translation_payload'"),
    (400, None, "Invalid value for 'messages'"),
    (404, None, "The model does not exist"),
]

_PLACEHOLDER_DROP = "%[a-z]|\\{[a-z]*\\}|<[^>]*>"


def catalog_number(catalog_id: Column) -> Column:
    """``srcN.lang`` -> N * 7 + code point of the language's first letter."""
    src = F.coalesce(F.regexp_extract(catalog_id, "^src([0-9]+)", 1).try_cast("bigint"), F.lit(0))
    lang = F.substring_index(catalog_id, ".", -1)
    return src * 7 + F.ascii(lang)


def mode_expr(catalog_id: Column, batch_no: Column, attempt: Column) -> Column:
    return ((catalog_number(catalog_id) * BY_CATALOG + batch_no * BY_BATCH + attempt * BY_ATTEMPT) % N_MODES).cast("int")


def _elements(m: Column, n_samples: Column, tl: Column) -> Column:
    n = F.size("items")

    def elem(it: Column, i: Column) -> Column:
        ctx = F.coalesce(it["msgctxt"], F.lit(""))
        ctx_out = F.when((m == 16) & (i == 0), F.concat(ctx, F.lit("#"))).when((m == 22) & (ctx == ""), F.lit(None)).otherwise(ctx)
        has_msgstr = ~((m == 18) & (i == n - 1))
        drop = (m == 23) | (m == 24)
        sing_src = F.when(drop, F.regexp_replace(it["msgid"], _PLACEHOLDER_DROP, "")).otherwise(it["msgid"])
        text = F.concat(F.lit("["), tl, F.lit("] "), sing_src)
        pl_src = F.when(drop, F.regexp_replace(it["msgid_plural"], _PLACEHOLDER_DROP, "")).otherwise(it["msgid_plural"])
        n_forms = F.when(n_samples > 0, n_samples).otherwise(F.lit(2))
        forms = F.transform(
            F.sequence(F.lit(0), n_forms - 1),
            lambda f: F.concat(F.lit("["), tl, F.lit("#"), f.cast("string"), F.lit("] "), pl_src),
        )
        forms = F.when(m == 21, F.slice(forms, 1, n_forms - 1)).otherwise(forms)
        id_out = F.when((m == 17) & (i == 0), F.concat(it["msgid"], F.lit("#"))).otherwise(it["msgid"])
        pl_out = F.when((m == 17) & (i == 0), F.concat(it["msgid_plural"], F.lit("#"))).otherwise(it["msgid_plural"])
        drop_nulls = {"ignoreNullFields": "true"}
        singular = (
            F.when(m == 20, F.to_json(F.struct(id_out.alias("msgid"), ctx_out.alias("msgctxt"), F.array(text).alias("msgstr")), drop_nulls))
            .when(
                m == 19,
                F.to_json(
                    F.struct(
                        id_out.alias("msgid"),
                        F.lit(None).cast("string").alias("msgid_plural"),
                        ctx_out.alias("msgctxt"),
                        text.alias("msgstr"),
                    ),
                    {"ignoreNullFields": "false"},
                ),
            )
            .otherwise(
                F.to_json(
                    F.struct(id_out.alias("msgid"), ctx_out.alias("msgctxt"), F.when(has_msgstr, text).alias("msgstr")),
                    drop_nulls,
                )
            )
        )
        plural = (
            F.when(
                m == 20,
                F.to_json(F.struct(pl_out.alias("msgid_plural"), ctx_out.alias("msgctxt"), forms[0].alias("msgstr")), drop_nulls),
            )
            .when(
                m == 19,
                F.to_json(
                    F.struct(F.lit("x").alias("msgid"), pl_out.alias("msgid_plural"), ctx_out.alias("msgctxt"), forms.alias("msgstr")),
                    drop_nulls,
                ),
            )
            .otherwise(
                F.to_json(
                    F.struct(pl_out.alias("msgid_plural"), ctx_out.alias("msgctxt"), F.when(has_msgstr, forms).alias("msgstr")),
                    drop_nulls,
                )
            )
        )
        return F.when(it["msgid_plural"].isNull(), singular).otherwise(plural)

    elems = F.transform("items", elem)
    return F.when(m == 15, F.slice(elems, 1, n - 1)).otherwise(elems)


def pseudo_attempts(requests: DataFrame, attempt: int | Column) -> DataFrame:
    """One attempt per request row: adds attempt, status, code, message, content.

    ``requests`` needs catalog_id, batch_no, items, target_language, samples.
    """
    att = F.lit(attempt) if isinstance(attempt, int) else attempt
    staged = requests.withColumn("attempt", att.cast("int")).withColumn(
        "__m", mode_expr(F.col("catalog_id"), F.col("batch_no"), F.col("attempt"))
    ).withColumn("__ns", F.coalesce(F.size("samples"), F.lit(0)))
    m = F.col("__m")
    body = F.concat(F.lit('{"translations":['), F.array_join(_elements(m, F.col("__ns"), F.col("target_language")), ","), F.lit("]}"))
    status = F.lit(200)
    code = F.lit(None).cast("string")
    message = F.lit(None).cast("string")
    for k in range(len(API_ERRORS) - 1, -1, -1):
        st, cd, msg = API_ERRORS[k]
        status = F.when(m == k, F.lit(st)).otherwise(status)
        code = F.when(m == k, F.lit(cd).cast("string")).otherwise(code)
        message = F.when(m == k, F.lit(msg)).otherwise(message)
    content = (
        F.when(m < len(API_ERRORS), F.lit(None).cast("string"))
        .when(m == 9, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(m == 10, F.lit(None).cast("string"))
        .when(m == 11, F.lit(" \n "))
        .when(m == 12, F.concat(F.lit("nope "), F.substring(body, 1, 20)))
        .when(m == 13, F.lit("[]"))
        .when(m == 14, F.lit('{"translations":{}}'))
        .otherwise(body)
    )
    return (
        staged.withColumn("status", status.cast("int"))
        .withColumn("code", code)
        .withColumn("message", message)
        .withColumn("content", content)
        .drop("__m", "__ns")
    )
