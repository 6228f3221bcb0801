"""Calendar and money rules."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import dec, rows, when
from tillbook.functions import dates, numbers


@pytest.mark.parametrize(
    ("start", "months", "end"),
    [
        ("2001-02-28 10:30:00", 1, "2001-03-31 10:30:00"),
        ("2000-02-28 10:30:00", 1, "2000-03-28 10:30:00"),
        ("2000-02-29 00:00:01", 12, "2001-02-28 00:00:01"),
        ("2001-03-31 12:00:00", -1, "2001-02-28 12:00:00"),
        ("2001-04-30 12:00:00", 1, "2001-05-31 12:00:00"),
        ("2001-04-29 12:00:00", 1, "2001-05-29 12:00:00"),
        ("2001-01-30 12:00:00", 1, "2001-02-28 12:00:00"),
        ("2001-07-31 12:00:00", -24, "1999-07-31 12:00:00"),
        ("2001-12-15 23:59:59", 1, "2002-01-15 23:59:59"),
    ],
)
def test_months_keep_time_and_snap_to_month_end(spark, start, months, end):
    assert dates.shift_months(when(start), months) == when(end)
    moved = spark.createDataFrame([(when(start),)], "t timestamp").select(dates.add_months(F.col("t"), months).alias("m"))
    assert moved.first()["m"] == when(end)


@pytest.mark.parametrize(
    ("ts", "months"),
    [
        ("2001-06-30 00:00:00", 1.0),  # both month ends
        ("2001-05-31 23:00:00", 2.0),  # same day of the month
        ("2001-07-31 12:00:00", 0.0),
        ("2001-07-30 12:00:00", 1 / 31),
        ("2001-07-30 00:00:00", 1.5 / 31),
    ],
)
def test_months_since(spark, ts, months):
    df = spark.createDataFrame([(when(ts),)], "t timestamp")
    got = df.select(dates.months_since(when("2001-07-31 12:00:00"), F.col("t")).alias("m")).first()["m"]
    assert got == pytest.approx(months, abs=1e-12)


def test_weekday_is_padded_to_nine(spark):
    days = spark.createDataFrame([(when("2001-07-30"),), (when("2001-08-01"),)], "t timestamp")
    got = [r["d"] for r in days.select(dates.padded_weekday(F.col("t")).alias("d")).collect()]
    assert got == ["Monday   ", "Wednesday"]


def test_elapsed_days_have_a_fraction(spark):
    df = spark.createDataFrame([(when("2001-07-31 06:00:00"),)], "t timestamp")
    assert df.select(dates.days_since(when("2001-08-01 12:00:00"), F.col("t"))).first()[0] == 1.25


def test_borders_of_a_month():
    moment = datetime(2000, 2, 11, 5)
    assert dates.month_start(moment) == datetime(2000, 2, 1)
    assert dates.month_end(moment) == datetime(2000, 2, 29)


def test_ratio_rounds_halves_away_from_zero_and_survives_zero(spark):
    df = spark.createDataFrame(
        [(dec("2.01"), 2), (dec("-2.01"), 2), (dec("1.00"), 3), (dec("5.00"), 0), (None, 4)], "a decimal(12,2), b long"
    )
    got = [r[0] for r in df.select(numbers.ratio(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [Decimal("1.01"), Decimal("-1.01"), Decimal("0.33"), None, None]


def test_at_least_keeps_null(spark):
    df = spark.createDataFrame([(-5,), (7,), (None,)], "v long")
    assert [r[0] for r in df.select(numbers.at_least(0, F.col("v"))).collect()] == [0, 7, None]


def test_weighted_sum_is_exact(spark):
    df = spark.createDataFrame([(dec("0.10"), 3), (dec("9999999999.99"), 1_000_000)], "v decimal(12,2), n long")
    assert rows(df.select(F.sum(numbers.weighted(F.col("v"), F.col("n"))).alias("s"))) == [
        {"s": Decimal("9999999999990000.30")}
    ]


def test_day_literal(spark):
    assert spark.range(1).select(dates.day_literal(datetime(2001, 7, 31, 12))).first()[0] == date(2001, 7, 31)
