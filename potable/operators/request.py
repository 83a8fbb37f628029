"""Model request construction: payload JSON, system message, call parameters.

All three are column expressions over the ``requests`` table (one row per
batch), so building a million requests is one projection.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potable.functions.text import PLACEHOLDER_KINDS, is_blank

DEFAULT_MODEL = "gpt-5.4"
DEFAULT_SOURCE_LANGUAGE = "en"

# The response contract (strict JSON schema). Each translated item
# is singular (msgid + string msgstr) or plural (msgid_plural + string-array
# msgstr), each with or without msgctxt; nothing else is allowed.
RESPONSE_SCHEMA = {
    "name": "translation_payload",
    "strict": True,
    "schema": {
        "type": "object",
        "additionalProperties": False,
        "required": ["translations"],
        "properties": {
            "translations": {
                "type": "array",
                "items": {
                    "anyOf": [
                        {
                            "type": "object",
                            "additionalProperties": False,
                            "required": ["msgid", "msgstr"],
                            "properties": {"msgid": {"type": "string"}, "msgstr": {"type": "string"}},
                        },
                        {
                            "type": "object",
                            "additionalProperties": False,
                            "required": ["msgid", "msgctxt", "msgstr"],
                            "properties": {
                                "msgid": {"type": "string"},
                                "msgctxt": {"type": "string"},
                                "msgstr": {"type": "string"},
                            },
                        },
                        {
                            "type": "object",
                            "additionalProperties": False,
                            "required": ["msgid_plural", "msgstr"],
                            "properties": {
                                "msgid_plural": {"type": "string"},
                                "msgstr": {"type": "array", "items": {"type": "string"}},
                            },
                        },
                        {
                            "type": "object",
                            "additionalProperties": False,
                            "required": ["msgid_plural", "msgctxt", "msgstr"],
                            "properties": {
                                "msgid_plural": {"type": "string"},
                                "msgctxt": {"type": "string"},
                                "msgstr": {"type": "array", "items": {"type": "string"}},
                            },
                        },
                    ]
                },
            }
        },
    },
}


def _member_shapes() -> list[str]:
    """One line per allowed member of the reply, read from the response schema."""
    kinds = {"string": "string", "array": "list of strings"}
    shapes = RESPONSE_SCHEMA["schema"]["properties"]["translations"]["items"]["anyOf"]
    return ["  - " + ", ".join(f"{name} ({kinds[p['type']]})" for name, p in shape["properties"].items()) for shape in shapes]


BASE_SYSTEM_MESSAGE = "\n".join([
    "Fill in a gettext message catalog.",
    "",
    "INPUT. One JSON object:",
    "  - translations: the messages, as members with msgid or msgid_plural, and msgctxt where a message has a context",
    "  - source_language, target_language: codes of the languages to translate from and into",
    "  - formula: the Plural-Forms rule of the target language",
    "  - plural_samples (optional): for each plural form its number and a count that selects it",
    "",
    f"OUTPUT. One JSON value that is valid under the schema {RESPONSE_SCHEMA['name']}, and nothing around it.",
    "Its member k answers input member k; both lists are equally long. A member has exactly the fields of one of these shapes:",
    *_member_shapes(),
    "Your text goes into msgstr. All other fields are copies of the input's.",
    "A list in msgstr holds a text per plural form: one per plural_samples member, in that order and fit for its count,",
    "or, where plural_samples is missing, the forms that the formula numbers.",
    "",
    "CODE INSIDE MESSAGES. These parts reach msgstr character by character as they are:",
    *[f"  - {name}" for name in PLACEHOLDER_KINDS],
])

PROJECT_SECTION_HEADER = "\n\nNOTES FROM THE PROJECT. They add to the above and never replace it:\n\n"


def system_message(context: Column | str | None) -> Column:
    """Base message plus a project section when the context is not blank.

    The blank test trims; the inserted context is not trimmed.
    """
    if context is None:
        return F.lit(BASE_SYSTEM_MESSAGE)
    c = F.col(context) if isinstance(context, str) else context
    return F.when(c.isNotNull() & ~is_blank(c), F.concat(F.lit(BASE_SYSTEM_MESSAGE + PROJECT_SECTION_HEADER), c)).otherwise(
        F.lit(BASE_SYSTEM_MESSAGE)
    )


RESPONSE_FORMAT_JSON = json.dumps({"type": "json_schema", "json_schema": RESPONSE_SCHEMA}, separators=(",", ":"))


def payload_struct(
    items: Column | str = "items",
    target_language: Column | str = "target_language",
    source_language: Column | str | None = None,
    formula: Column | str = "formula",
    samples: Column | str = "samples",
) -> Column:
    """Payload as a struct in the wire key order; optional parts are null."""

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    src = F.lit(DEFAULT_SOURCE_LANGUAGE) if source_language is None else F.coalesce(c(source_language), F.lit("en"))
    smp = c(samples)
    return F.struct(
        F.coalesce(c(formula), F.lit("")).alias("formula"),
        c(target_language).alias("target_language"),
        src.alias("source_language"),
        F.transform(
            c(items),
            lambda x: F.struct(
                x["msgid"].alias("msgid"), x["msgid_plural"].alias("msgid_plural"), x["msgctxt"].alias("msgctxt")
            ),
        ).alias("translations"),
        F.when(F.size(smp) > 0, smp).alias("plural_samples"),
    )


def payload_json(payload: Column) -> Column:
    """Serialise: null fields dropped, empty strings kept."""
    return F.to_json(payload, {"ignoreNullFields": "true"})


def with_payload(requests: DataFrame, source_language: Column | str | None = None, context: Column | str | None = None,
                 model: str | Column | None = None) -> DataFrame:
    """Add ``payload_json``, ``system_message`` and the call parameters."""
    m = model if isinstance(model, Column) else F.lit(model or DEFAULT_MODEL)
    return (
        requests.withColumn("payload_json", payload_json(payload_struct(source_language=source_language)))
        .withColumn("system_message", system_message(context))
        .withColumn("model", m)
        .withColumn("temperature", F.lit(0).cast("int"))
        .withColumn("response_format", F.lit(RESPONSE_FORMAT_JSON))
    )


def request_body(requests: DataFrame) -> DataFrame:
    """Chat-completions request body as JSON, per batch (what a live provider posts)."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.col("system_message").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("payload_json").alias("content")),
    )
    return requests.withColumn(
        "request_body",
        F.concat(
            F.lit('{"model":'),
            F.to_json(F.array(F.col("model"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("model")))) - 2),
            F.lit(',"temperature":0,"response_format":'),
            F.lit(RESPONSE_FORMAT_JSON),
            F.lit(',"messages":'),
            F.to_json(msgs),
            F.lit("}"),
        ),
    )
