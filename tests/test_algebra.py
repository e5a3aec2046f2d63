import math

import pytest

from rasterlake.functions.algebra import compile_expression


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([(3.0, 4.0, None)], "b1 double, b2 double, b3 double")

    def value(text, bands=3):
        return df.select(compile_expression(text, bands).alias("v")).first().v

    return value


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("B1 + B2 * 2", 11), ("(B1 + B2) * 2", 14), ("B2 - B1 - 1", 0), ("-B1 + 5", 2), ("2 * -B1", -6), ("1e-1 * B1", 0.3), ("B1 > 2", 1), ("B1 > B2", 0), ("(B1 > 2) * B2", 4),
        ("B1 + 1 >= B2", 1), ("B1 == 3", 1), ("B1 != 3", 0), ("and(B1 > 2, B2 < 3)", 0), ("or(B1 > 2, B2 < 3)", 1), ("not(B1 > 2)", 0), ("if(B1 > 2, 10, 20)", 10), ("between(B1, 3, 4)", 1),
        ("clamp(B2, 0, 3.5)", 3.5), ("min(B1, B2)", 3), ("max(B1, B2)", 4), (".5*B2", 2),
    ],
)
def test_values(row, text, want):
    assert math.isclose(row(text), want, rel_tol=1e-12)


def test_division_adds_epsilon(row):
    assert row("B1 / (B2 - B2)") == pytest.approx(3e6)
    assert row("(B1 - B1) / (B2 - B2)") == 0


def test_null_pixels_stay_null(row):
    assert row("B3 * 2 + B1") is None
    assert row("B3 > 1") is None
    for text in ("and(B1, B3)", "not(B3)", "if(B3, 1, 2)", "if(1, B3, 2)", "if(1, 2, B3)", "between(B3, 1, 2)", "between(1, B3, 2)", "min(B3, B3)", "max(B3, B3)", "or(B3, B3)", "-B3", "B1 / B3"):
        assert row(text) is None, text


def test_smallest_and_largest_leave_nulls_out(row):
    assert (row("min(B1, B3)"), row("max(B3, B2)"), row("or(B3, 1)"), row("clamp(B3, 2, 5)"), row("clamp(B2, B3, 3)"), row("clamp(B1, 3.5, B3)")) == (3, 4, 1, 5, 3, 3.5)


@pytest.mark.parametrize("text", ["", "  ", "B1 +", "B4", "B0", "foo", "foo(B1)", "B1 = 2", "(B1", "B1)", "B1 B2", "min(B1)", "1,2", "B1 $ 2"])
def test_errors(text):
    with pytest.raises(ValueError):
        compile_expression(text, 3)
