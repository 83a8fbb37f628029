from hypothesis import given, settings
from hypothesis import strategies as st

from potable.operators.locale import LANGUAGES, PLURAL_RULES, plural_sample_dim
from potable.operators.plural_formula import evaluate, formula_samples, own_plural_samples


def test_known_formulas_give_their_rules_samples(spark):
    dim = {r["family"]: [(s["plural"], s["sample"]) for s in r["samples"]] for r in plural_sample_dim(spark).collect()}
    assert set(dim) == set(LANGUAGES.values())
    for family, (forms, formula, _) in PLURAL_RULES.items():
        assert evaluate(formula) == (forms, dim[family], None), family


def test_faults():
    for header, expected in {
        None: (None, "missing"), " \t": (None, "missing"), "plural=n;": (None, "nplurals"), "nplurals=0; plural=0": (None, "nplurals"),
        "nplurals=INTEGER; plural=EXPRESSION;": (None, "nplurals"), "nplurals=2;": (2, "syntax"), "nplurals=2; plural=n+": (2, "syntax"),
        "nplurals=2; plural=n n": (2, "syntax"), "nplurals=2; plural=n=1": (2, "syntax"), "nplurals=2; plural=(n>1": (2, "syntax"),
        "nplurals=2; plural=n?1": (2, "syntax"), "nplurals=2; plural=-n": (2, "syntax"), "nplurals=2; plural=n & 1": (2, "syntax"),
        "nplurals=2; plural=__import__('os')": (2, "syntax"), "nplurals=2; plural=1/n": (2, "division"),
        "nplurals=2; plural=n%3": (2, "range"), "nplurals=2; plural=n-1": (2, "range"),
        "nplurals=2; plural=" + "(" * 100_000 + "n": (2, "syntax"),
    }.items():
        forms, samples, fault = evaluate(header)
        assert (forms, fault) == expected and samples is None, header


def test_lazy_operators_and_precedence():
    assert evaluate("nplurals=2; plural=n && 6/n>2")[1] == [(0, 3), (1, 1)]
    assert evaluate("nplurals=2; plural=!n || 6/n>2")[1] == [(0, 3), (1, 1)]
    assert evaluate("nplurals=3; plural=n==0 ? 2 : n%2==1 ? 1 : 0")[1] == [(0, 2), (1, 1), (2, 0)]
    assert evaluate("nplurals=2; plural=10-n-9 == 0")[1] == [(0, 2), (1, 1)]  # from the left
    assert evaluate("nplurals=3; plural=1")[1] == [(0, None), (1, 1), (2, None)]


_expr = st.recursive(
    st.one_of(st.just("n"), st.integers(0, 20).map(str)),
    lambda e: st.one_of(
        st.tuples(e, st.sampled_from(["+", "*", "<", "<=", ">", ">=", "==", "!="]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
        st.tuples(e, st.integers(1, 9), st.sampled_from(["%", "/"])).map(lambda t: f"({t[0]} {t[2]} {t[1]})"),
    ),
    max_leaves=8,
)


@settings(max_examples=200, deadline=None)
@given(_expr)
def test_against_python(text):
    value = [int(eval(text.replace("/", "//"), {"n": n})) % 2**64 % 7 for n in range(201)]
    expected = [(f, next((n for n in [*range(1, 201), 0] if value[n] == f), None)) for f in range(7)]
    assert evaluate(f"nplurals=7; plural=({text}) % 7;") == (7, expected, None)


def test_catalogs_fall_back_to_their_locale(spark):
    rows = [
        ("a", "nplurals=3; plural=n==1 ? 0 : n==7 ? 1 : 2;", "en"), ("b", "nplurals=3; plural=n==1 ? 0 : n==7 ? 1 : 2;", "xx"),
        ("c", "nplurals=3; plural=n>;", "en"), ("d", None, "uk"), ("e", "", "xx"), ("f", "nplurals=3; plural=n>1", "fr"),
    ]
    cats = spark.createDataFrame(rows, "catalog_id string, formula string, locale string")
    got = {r["catalog_id"]: r for r in own_plural_samples(cats).collect()}
    shown = {k: (r["samples_from"], r["samples"] and [s["sample"] for s in r["samples"]]) for k, r in got.items()}
    assert shown == {
        "a": ("formula", [1, 7, 2]), "b": ("formula", [1, 7, 2]), "c": ("locale", [1, 2]), "d": ("locale", [1, 2, 5]),
        "e": (None, None), "f": ("locale", [1, 2]),
    }
    assert own_plural_samples(cats.limit(0)).count() == 0
    again = formula_samples(cats.unionAll(cats), ["catalog_id"])
    assert again.count() == 12
