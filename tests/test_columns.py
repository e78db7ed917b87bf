"""Column functions against hand-worked values."""

import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetmeter.functions import dates, numbers, text
from fleetmeter.functions.numbers import exact_sum, mean_price, total_price
from fleetmeter.functions.text import number_text, price_text


def values(spark, expression, inputs, kind):
    frame = spark.createDataFrame([(v,) for v in inputs], f"x {kind}")
    return [row[0] for row in frame.select(expression(F.col("x"))).collect()]


AMOUNTS = [
    (0.0, "Rp 0,00", "0"),
    (999.0, "Rp 999,00", "999"),
    (1000.0, "Rp 1,00 rb", "1,00 rb"),
    (1125.0, "Rp 1,12 rb", "1,12 rb"),
    (1135.0, "Rp 1,14 rb", "1,14 rb"),
    (2500000.0, "Rp 2,50 jt", "2,50 jt"),
    (1e9, "Rp 1,00 M", "1,00 M"),
    (3.2e12, "Rp 3,20 T", "3,20 T"),
    (-5.25, "Rp -5,25", "-5"),
    (2.5, "Rp 2,50", "2"),
    (None, None, None),
]


def test_amount_texts(spark):
    amounts = [a for a, _, _ in AMOUNTS]
    assert values(spark, text.price_text, amounts, "double") == [p for _, p, _ in AMOUNTS]
    assert values(spark, text.number_text, amounts, "double") == [n for _, _, n in AMOUNTS]


def test_grouped_text(spark):
    shown = values(spark, text.grouped_text, [1234567.5, 2.5, 0.0, None], "double")
    assert shown == ["1,234,568", "3", "0", None]


def test_rounding_is_half_even(spark):
    assert values(spark, numbers.whole, [0.5, 1.5, 2.5, -0.5], "double") == [0, 2, 2, 0]


def test_number_or_zero(spark):
    texts = ["12.5", "abc", "", None, "NaN"]
    assert values(spark, lambda c: numbers.number_or_zero("x"), texts, "string") == [12.5, 0, 0, 0, 0]


def test_lenient_and_strict_timestamps(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02", "soon", None]
    parsed = values(spark, lambda c: dates.parse_timestamp_lenient("x"), texts, "string")
    assert parsed == [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2), None, None]
    with pytest.raises(Exception):
        values(spark, lambda c: dates.parse_timestamp("x"), ["soon"], "string")


LABELS = {
    "day": "2024-12-30", "week": "2025-W01", "month": "2024-12", "quarter": "2024-Q4",
    "semester": "2024-S2", "year": "2024",
}


@pytest.mark.parametrize("grain", dates.GRAINS)
def test_period_labels(spark, grain):
    frame = spark.createDataFrame([(datetime.datetime(2024, 12, 30, 23),), (None,)], "x timestamp_ntz")
    started = frame.select(dates.period_start("x", grain).alias("start"))
    shown = [r[0] for r in started.select(dates.period_label(F.col("start"), grain)).collect()]
    assert shown == [LABELS[grain], None]


@settings(max_examples=60, deadline=None)
@given(st.dates(datetime.date(1990, 1, 1), datetime.date(2060, 1, 1)))
def test_bounds_hold_their_days(day):
    iso = day.isocalendar()
    labels = {
        "day": day.isoformat(), "week": f"{iso.year}-W{iso.week:02}", "month": f"{day:%Y-%m}",
        "quarter": f"{day.year}-Q{(day.month + 2) // 3}",
        "semester": f"{day.year}-S{1 if day.month <= 6 else 2}", "year": f"{day.year}",
    }
    for grain, label in labels.items():
        start, after = dates.period_bounds(label, grain)
        assert start <= day < after


def test_bad_label_is_an_error():
    with pytest.raises(ValueError):
        dates.period_bounds("2024-13-", "month")


NAMES = [
    ("Filter OLI 15W40 Toyota (asli)", "Filter OLI asli", "Filter OLI", 2),
    ("40W", "", "", 0),
    ("  Ban-luar  FORD ", "Banluar", "Banluar", 1),
    ("Fordson é oli", "Fordson oli", "Fordson oli", 2),
    ("éé1 kampas", "kampas", "kampas", 1),
    (None, None, None, None),
]


def test_clean_names(spark):
    raw = [n[0] for n in NAMES]
    assert values(spark, text.clean_name, raw, "string") == [n[1] for n in NAMES]
    shown = values(spark, lambda c: text.first_words(text.clean_name(c)), raw, "string")
    assert shown == [n[2] for n in NAMES]
    counts = values(
        spark, lambda c: text.word_count(text.first_words(text.clean_name(c))), raw, "string"
    )
    assert counts == [n[3] for n in NAMES]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sums_have_no_ceiling(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        large = spark.createDataFrame([(6e16,)] * 4 + [(0.004,)] * 3 + [(None,)], "total_price double")
        assert large.agg(exact_sum("total_price")).first()[0] == Decimal("240000000000000000.012000")
        huge = spark.createDataFrame([(3e22,), (-1e22,), (0.5,)], "total_price double")
        assert huge.agg(total_price()).first()[0] == 2e22
        assert large.where("total_price IS NULL").agg(total_price(), mean_price()).first() == (0.0, None)
        small = spark.createDataFrame([(0.004,), (-0.25,), (0.1,), (0.2,)], "total_price double")
        assert small.agg(total_price()).first()[0] == 0.054
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_texts_have_no_ceiling(spark):
    amounts = spark.createDataFrame([(1e19,), (1e24,), (2.5e18,), (-3.0,)], "amount double")
    shown = [r[0] for r in amounts.select(price_text(F.col("amount"))).collect()]
    assert shown == ["Rp 10000000,00 T", "Rp 1000000000000,00 T", "Rp 2500000,00 T", "Rp -3,00"]


@pytest.mark.parametrize("amount", [-2e19, -1e19, -1.5e23, -123456789e20, -4e37, 1e18, 3e25, 1e23 * 7, 1.2345e36])
def test_digits_of_large_amounts(spark, amount):
    """As Python writes the same doubles, digit by digit."""
    price, number = spark.range(1).select(price_text(F.lit(amount)), number_text(F.lit(amount))).first()
    if amount < 0:
        assert price == f"Rp {amount:.2f}".replace(".", ",") and number == f"{amount:.0f}"
    else:
        assert price == f"Rp {amount / 1e12:.2f} T".replace(".", ",")
