"""Scalar expressions: display formats, ordinal position, rounding."""

from __future__ import annotations

from learnlens.functions.expressions import (
    fixed_text,
    grouped_number,
    ordinal_position,
    percent_text,
    round_columns,
)
from learnlens.params import LEVEL_NAMES


def test_display_formats(spark):
    df = spark.createDataFrame([(61.25,), (69.35,), (1005.5,), (1234567.0,), (0.0,), (None,), (-1234.5,)], "x double")
    # 69.35 is a little less than its text says.
    got = [tuple(r) for r in df.select(percent_text("x"), fixed_text("x", 1), grouped_number("x")).collect()]
    assert got == [
        ("61.3%", "61.3", "61.25"),
        ("69.3%", "69.3", "69.35"),
        ("1005.5%", "1005.5", "1,005.5"),
        ("1234567.0%", "1234567.0", "1,234,567"),
        ("0.0%", "0.0", "0"),
        ("0.0%", "0.0", "0"),
        ("-1234.5%", "-1234.5", "-1,234.5"),
    ]


def test_ordinal_position(spark):
    df = spark.createDataFrame([(n,) for n in LEVEL_NAMES + ("other",)], "score_level string")
    assert [r[0] for r in df.select(ordinal_position("score_level", LEVEL_NAMES)).collect()] == [1, 2, 3, 4, 0]


def test_round_half_up(spark):
    df = spark.createDataFrame([(1.005, 2.675, 59.665)], "a double, b double, c double")
    assert tuple(round_columns(df, ["a", "b", "c"]).collect()[0]) == (1.01, 2.68, 59.67)


def test_display_digits_are_those_of_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    import random

    rng = random.Random(6)
    xs = [37.15, 19.15, 0.25, 0.05, 0.15, 99.95, 0.125, 1.005, 2.675, 8.345, 0.0, 100.0, 59.999999]
    xs += [round(rng.uniform(0, 100), rng.choice([2, 3, 4])) for _ in range(2000)] + [i / 8 for i in range(800)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fixed_text("x", 1), fixed_text("x", 2)).collect()
    for x, one, two in got:
        # Decimal(x) is the double's exact value.
        assert one == str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))
        assert two == str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert [r[1] for r in got[:3]] == ["37.1", "19.1", "0.3"]


def test_grouped_number_rounds_half_up(spark):
    df = spark.createDataFrame([(1.0005,), (2.0015,), (1000.0,), (100.0,)], "x double")
    assert [r[0] for r in df.select(grouped_number("x")).collect()] == ["1.001", "2.002", "1,000", "100"]
