"""String predicates and projections with JavaScript string semantics.

Everything here returns a ``Column`` built from JVM-side functions, so the
expressions stay inside whole-stage codegen and can be used in filters,
projections and higher-order lambdas alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of JavaScript ``String.prototype.trim``
# (tab, LF, VT, FF, CR, space, NBSP, OGHAM SPACE, U+2000..U+200A, LS, PS,
# NNBSP, MMSP, IDEOGRAPHIC SPACE, BOM). U+0085 is not part of it.
JS_WS_CLASS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

# Same class for RE2 (DuckDB oracle SQL).
JS_WS_CLASS_RE2 = (
    "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
    "\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
)

MACHINE_MARKER = "ai-translated"
FUZZY = "fuzzy"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_trim(col: Column | str) -> Column:
    """``String.trim``: strip the JS whitespace set from both ends."""
    return F.regexp_replace(_c(col), f"\\A{JS_WS_CLASS}+|{JS_WS_CLASS}+\\z", "")


def is_blank(col: Column | str) -> Column:
    """True when the string is empty or only JS whitespace (null counts as blank)."""
    return F.coalesce(_c(col), F.lit("")).rlike(f"\\A{JS_WS_CLASS}*\\z")


def is_untranslated(msgstr: Column | str) -> Column:
    """No ``msgstr``, an empty list, or every form blank (non-strings count as blank)."""
    forms = F.coalesce(_c(msgstr), F.array().cast("array<string>"))
    return F.forall(forms, lambda x: is_blank(x))


def flag_tokens(flag: Column | str) -> Column:
    """Flag string split on ',' (empty string for null), tokens JS-trimmed."""
    return F.transform(F.split(F.coalesce(_c(flag), F.lit("")), ","), lambda x: js_trim(x))


def is_fuzzy(flag: Column | str) -> Column:
    """Any comma-separated flag that trims and lower-cases to ``fuzzy``."""
    return F.exists(flag_tokens(flag), lambda x: F.lower(x) == F.lit(FUZZY))


def is_integer_key(col: Column | str) -> Column:
    """JavaScript array-index key: canonical decimal integer in [0, 2^32 - 2].

    Such keys enumerate first (ascending) in JS objects, which reorders the
    parser's contexts and msgids.
    """
    c = _c(col)
    canonical = c.rlike("\\A(0|[1-9][0-9]{0,9})\\z")
    return canonical & (F.when(canonical, c.cast("bigint")).otherwise(F.lit(None)) <= F.lit(4294967294))


def integer_key_value(col: Column | str) -> Column:
    """Numeric value of an integer-like key, else null."""
    c = _c(col)
    return F.when(is_integer_key(c), c.cast("bigint"))


def split_lines(col: Column | str) -> Column:
    """Split on CRLF, LF or CR (the JS ``/\\r?\\n|\\r/`` rule)."""
    return F.split(_c(col), "\\r?\\n|\\r")


# Placeholder grammar, by kind. A conversion with the space flag is
# left out: "50% discount" is text.
PLACEHOLDER_KINDS = {
    "printf conversions, numbered or named ones too":
        "%(?:[0-9]+\\$)?(?:\\([A-Za-z_][A-Za-z0-9_]*\\))?[-+#0]*[0-9]*(?:\\.[0-9]+)?[hlLqjzt]*[diouxXeEfFgGcrsaAp%]",
    "interpolations in a dollar sign and braces": "\\$\\{[^{}]*\\}",
    "names or numbers in braces": "\\{[A-Za-z0-9_]*\\}",
    "HTML and XML tags": "</?[A-Za-z][A-Za-z0-9:-]*(?:[ \\t\\n\\r][^<>]*)?/?>",
}
PLACEHOLDER_PATTERN = "|".join(PLACEHOLDER_KINDS.values())


def placeholders(col: Column | str) -> Column:
    """Sorted multiset of placeholders found in a string (``%%`` is not one)."""
    found = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(f"({PLACEHOLDER_PATTERN})"), 1)
    return F.array_sort(F.filter(found, lambda x: x != F.lit("%%")))
