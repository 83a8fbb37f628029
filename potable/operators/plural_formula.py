"""Plural samples of a catalog's own ``Plural-Forms`` formula.

Distinct formulas are evaluated in tasks, each once, over all counts 0..200 at a time;
nothing is gathered on the driver, however many formulas there are. The grammar is that
of gettext: integers, ``n``, ``?:``, ``||``, ``&&``, comparisons, ``+ - * / %``, ``!`` and
parentheses, on unsigned 64-bit numbers.

Defined results: a formula that can't be used has null samples and a ``fault``: ``missing``
(null or blank), ``nplurals`` (no number from 1 to 100), ``syntax``, ``division`` (by zero at some
count) or ``range`` (a form that isn't below ``nplurals``). A form that no count reaches has
a null sample. Repeated catalogs get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potable.operators.locale import SAMPLE_SEARCH_MAX, lookup_plural_samples
from potable.operators.spread import spread_join

# functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: values at all counts, and whether computing them divides by zero
Values = tuple[np.ndarray, np.ndarray]
Term = Callable[[np.ndarray], Values]

# Binary operators of C from loose to tight.
BINARY = [
    {"||": np.logical_or},
    {"&&": np.logical_and},
    {"==": operator.eq, "!=": operator.ne},
    {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge},
    {"+": operator.add, "-": operator.sub},
    {"*": operator.mul, "/": operator.floordiv, "%": operator.mod},
]
MOST_FORMS = 100
_TOKEN = re.compile(r"\s*(?:([0-9]{1,18}(?![0-9])|n\b|\|\||&&|[=!<>]=|[-+*/%<>!?:()])|(\S))")
SAMPLES = "array<struct<plural:int,sample:int>>"


class Formula:
    """A formula's text as a function of an array of counts; a ``ValueError`` if it isn't one."""

    def __init__(self, text: str) -> None:
        self.tokens = []
        for token, other in _TOKEN.findall(text):
            if other:
                raise ValueError(other)
            self.tokens.append(token)
        self.tokens.append("")
        self.at = 0
        self.value = self._choice()
        if self.tokens[self.at]:
            raise ValueError(self.tokens[self.at])

    def _next(self, *wanted: str) -> str:
        token = self.tokens[self.at]
        if wanted and token not in wanted:
            return ""
        self.at += 1
        return token

    def _choice(self) -> Term:
        test = self._level(0)
        if not self._next("?"):
            return test
        yes = self._choice()
        if not self._next(":"):
            raise ValueError("?")
        no = self._choice()

        def choose(n: np.ndarray) -> Values:
            (c, bad), (a, bad_a), (b, bad_b) = test(n), yes(n), no(n)
            return np.where(c != 0, a, b), bad | np.where(c != 0, bad_a, bad_b)

        return choose

    def _level(self, level: int) -> Term:
        if level == len(BINARY):
            return self._unary()
        left = self._level(level + 1)
        while sign := self._next(*BINARY[level]):
            left = _joined(sign, BINARY[level][sign], left, self._level(level + 1))
        return left

    def _unary(self) -> Term:
        token = self._next()
        if token == "!":
            return _negated(self._unary())
        if token == "(":
            inner = self._choice()
            if not self._next(")"):
                raise ValueError("(")
            return inner
        if token == "n":
            return lambda n: (n, np.zeros(len(n), dtype=bool))
        if token.isdigit():
            return lambda n: (np.full(len(n), int(token), dtype=np.uint64), np.zeros(len(n), dtype=bool))
        raise ValueError(token)


def _negated(inner: Term) -> Term:
    def run(n: np.ndarray) -> Values:
        a, bad = inner(n)
        return (a == 0).astype(np.uint64), bad

    return run


def _joined(sign: str, compute: Callable, left: Term, right: Term) -> Term:
    def run(n: np.ndarray) -> Values:
        (a, bad_a), (b, bad_b) = left(n), right(n)
        if sign in ("||", "&&"):  # the right side counts only where the left one doesn't decide
            bad_b = bad_b & ((a != 0) if sign == "&&" else (a == 0))
        if sign in ("/", "%"):
            bad_b, b = bad_b | (b == 0), np.maximum(b, 1)
        return compute(a, b).astype(np.uint64), bad_a | bad_b

    return run


def evaluate(header: str | None) -> tuple[int | None, list[tuple[int, int | None]] | None, str | None]:
    """(nplurals, samples, fault) of the value of a ``Plural-Forms`` header."""
    parts = dict(p.split("=", 1) for p in (header or "").split(";") if "=" in p)
    parts = {k.strip(): v.strip() for k, v in parts.items()}
    if not (header or "").strip():
        return None, None, "missing"
    size = parts.get("nplurals", "")
    if not (re.fullmatch("[0-9]{1,3}", size) and 1 <= int(size) <= MOST_FORMS):
        return None, None, "nplurals"
    forms = int(size)
    try:
        value = Formula(parts.get("plural", "")).value
        got, bad = value(np.arange(SAMPLE_SEARCH_MAX + 1, dtype=np.uint64))
    except (ValueError, RecursionError):
        return forms, None, "syntax"
    if bad.any():
        return forms, None, "division"
    if (got >= forms).any():
        return forms, None, "range"
    found, first = np.unique(got[1:], return_index=True)
    samples = {int(got[0]): 0} | {int(f): int(i) + 1 for f, i in zip(found, first)}
    return forms, [(f, samples.get(f)) for f in range(forms)], None


def formula_samples(rows: DataFrame, by: list[str], formula: str = "formula") -> DataFrame:
    """``rows`` with ``formula_nplurals``, ``formula_samples`` and ``formula_fault`` of their own formula.

    ``by`` names columns that tell rows with the same formula apart (many catalogs share one).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [evaluate(text) for text in frame["__formula"]]
            yield pd.DataFrame({
                "__formula": frame["__formula"],
                "formula_nplurals": pd.array([f[0] for f in found], dtype="Int32"),
                "formula_samples": [f[1] and [{"plural": p, "sample": s} for p, s in f[1]] for f in found],
                "formula_fault": [f[2] for f in found],
            })

    own = rows.withColumn("__formula", F.coalesce(formula, F.lit("")))
    schema = f"__formula string, formula_nplurals int, formula_samples {SAMPLES}, formula_fault string"
    results = own.select("__formula").distinct().mapInPandas(run, schema)
    return spread_join(own, results, ["__formula"], by=by).drop("__formula")


def own_plural_samples(catalogs: DataFrame) -> DataFrame:
    """Catalogs with ``samples`` of their own formula (``samples_from`` is ``formula``) where that is
    usable and every form is reached, else those of their locale (``locale``), if it has any."""
    both = formula_samples(lookup_plural_samples(catalogs), by=["catalog_id"])
    whole = F.col("formula_fault").isNull() & ~F.exists("formula_samples", lambda s: s["sample"].isNull())
    return both.withColumn(
        "samples_from", F.when(whole, F.lit("formula")).when(F.col("samples").isNotNull(), F.lit("locale"))
    ).withColumn("samples", F.when(whole, F.col("formula_samples")).otherwise(F.col("samples")))
