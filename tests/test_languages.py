"""Selectors, quantile tokens, patterns and the expression grammar."""

import pytest

from quernel.functions import regexes, selectors
from quernel.functions.expressions import ExpressionError, tokens
from quernel.functions.quantiles import fraction
from quernel.sources.text import rounded

NAMES = ["id", "IL6", "TNF", "IL10", "a,b"]


@pytest.mark.parametrize("text, want", [
    ("id,TNF", [0, 2]), ("3,1", [2, 0]), ("-1", [4]), ("IL6:IL10", [1, 2, 3]), (":TNF", [0, 1, 2]), ("IL10:", [3, 4]), (":", [0, 1, 2, 3, 4]),
    ("`a,b`,{id}", [4, 0]), (":-2", [0, 1, 2, 3]), ("-2:", [3, 4]), ("id,", [0]), ("id,id", [0, 0]), ("{IL6}:{IL10}", [1, 2, 3]),
])
def test_selectors(text, want):
    assert selectors.columns(text, NAMES) == want


@pytest.mark.parametrize("text", ["0", "-0", "9", "nope", "TNF:id", "id,,TNF", "`open", "a:b:c"])
def test_wrong_selectors(text):
    with pytest.raises(selectors.SelectorError):
        selectors.columns(text, NAMES)


def test_names_need_a_header():
    with pytest.raises(selectors.SelectorError):
        selectors.columns("id", NAMES, has_header=False)
    assert selectors.columns("2", NAMES, has_header=False) == [1]


def test_first_of_equal_names_and_quoted_digits():
    assert selectors.columns("a", ["a", "a"]) == [0]
    assert selectors.columns("`1`", ["x", "1"]) == [1]


def test_row_spans():
    assert selectors.row_spans("1,3:5,:2,-2:,7:") == [(1, 1), (3, 5), (None, 2), (-2, None), (7, None)]
    with pytest.raises(selectors.SelectorError):
        selectors.row_spans("0")


@pytest.mark.parametrize("token, want", [("q1", 0.25), ("q4", 1.0), ("q5", 0.05), ("q25", 0.25), ("q0.9", 0.9), ("q0_9", 0.9), ("q1.0", 1.0), ("p90", 0.9), ("p101", None), ("q101", None), ("sum", None)])
def test_quantile_tokens(token, want):
    assert fraction(token) == want


def test_minus_in_names():
    kinds = lambda e: [(t.kind, t.value) for t in tokens(e)]
    assert kinds("$foo-bar") == [("column", "foo-bar")]
    assert kinds("$a-$b") == [("column", "a"), ("op", "-"), ("column", "b")]
    assert kinds("$1-2")[1] == ("op", "-")
    assert kinds("${dna-} - $rna_ug")[0] == ("column", "dna-")
    assert [t.kind for t in tokens("$a:-2")] == ["columns", "op", "number"]
    assert kinds("$-1") == [("column", -1)]
    assert tokens('"a\\tb\\d\\""')[0].value == 'a\tb\\d"'


@pytest.mark.parametrize("text", ['"open', "${open", "$", "a ? b"])
def test_wrong_tokens(text):
    with pytest.raises((ExpressionError, selectors.SelectorError)):
        tokens(text)


def test_patterns():
    java, groups = regexes.translate(r"^(?P<first_name>\w+)-(\d)$")
    assert java == r"(?dU)^(\w+)-(\d)\z" and groups["first_name"] == 1
    assert regexes.template("${first_name}$$1$3-$2x", groups) == "$1\\$1-"
    assert regexes.template("$2 a\\", groups) == "$2 a\\\\"
    for bad in (r"(a)\1", "(?=a)", "(?<!a)"):
        with pytest.raises(regexes.PatternError):
            regexes.translate(bad)


@pytest.mark.parametrize("text, digits, want", [("3.14159", 2, "3.14"), ("2.50", 2, "2.5"), ("007", 1, "7"), ("0.00001234", 2, "1.23e-5"), ("abc", 2, "abc"), ("0", 2, "0"), ("-1.005e3", 1, "-1005")])
def test_rounded(text, digits, want):
    assert rounded(text, digits) == want
