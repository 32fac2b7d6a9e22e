"""Golden cases of the parsers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestor.functions import parsing as P
from attestor.operators.resolution import learn_year_end

# What the parsers must give.
NUMBERS = [
    ("1,240", None, 1240.0), ("98,135", None, 98135.0), ("1,240", "crore", 12400000000.0), ("1,240 crore", None, 12400000000.0),
    ("₹1,240 Cr", None, 12400000000.0), ("412.6", "million", 412600000.0), ("(1,008)", None, -1008.0), ("(452", None, -452.0),
    ("(1,008 Cr)", None, -10080000000.0), ("5.03%", None, 5.03), ("(5.6%)", None, -5.6), (">2.8Bn", None, 2800000000.0),
    (">33,200", None, 33200.0), ("18.8Mn Sq ft", None, 18800000.0), ("4.8", "Mn tonnes", 4800000.0), ("9,177", None, 9177.0),
    ("no digits at all", None, None), ("3,851", "lakh", 385100000.0), ("40", "percent", 40.0), ("1.6", "%", 1.6),
]
DATES = [
    ("March 31, 2024", "2024-03-31"), ("31 March 2024", "2024-03-31"), ("31-03-2024", "2024-03-31"), ("2024-03-31", "2024-03-31"),
    ("Mar '24", "2024-03-31"), ("December 31, 2021", "2021-12-31"), ("30 June 2024", "2024-06-30"), ("2023", "2023-12-31"),
    ("February 2024", "2024-02-29"), ("nonsense", None),
]
PERIODS = [
    ("year ended 31 March 2024", "2023-04-01", "2024-03-31"), ("nine months period ended December 31, 2021", "2021-04-01", "2021-12-31"),
    ("Q4 FY24", "2024-01-01", "2024-03-31"), ("Q1 FY24", "2023-04-01", "2023-06-30"), ("FY24", "2023-04-01", "2024-03-31"),
    ("Fiscal 2021", "2020-04-01", "2021-03-31"), ("quarter ended March 31, 2024", "2024-01-01", "2024-03-31"),
    ("six months ended September 30, 2023", "2023-04-01", "2023-09-30"),
]
# Cases added here.
NUMBERS += [("₹(452)", None, 452.0), ("1 million crore", None, 1e6), ("", None, None), (None, None, None), ("5.", None, 5.0)]
DATES += [("March 31", "2031-03-31"), ("31-02-2024", None), (None, None), ("", None)]
PERIODS += [("FY 2023-24", "2022-04-01", "2023-03-31"), ("as at 5 May 2020", "2020-05-05", "2020-05-05"), ("whenever", None, None), (None, None, None)]
day = lambda x: dt.date.fromisoformat(x) if x else None


def test_numbers(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(NUMBERS)], "i int, value string, unit string, expected double")
    for r in df.select("value", "unit", "expected", P.parse_number(F.col("value"), F.col("unit")).alias("p")).collect():
        assert r.p.value == pytest.approx(r.expected, abs=0.001) if r.expected is not None else r.p.value is None, r
        assert (r.p.failure is None) == (r.expected is not None)


def test_number_flags(spark):
    df = spark.createDataFrame([("others. 5", None), ("overall 5", None), ("us$ 7", None), ("5 purse", "rs"), ("x", "$")], "v string, u string")
    got = [r.p for r in df.select(P.parse_number(F.col("v"), F.col("u")).alias("p")).collect()]
    assert [g.currency for g in got] == ["INR", None, "USD", "INR", "USD"]
    assert [g.approximate for g in got] == [False, True, False, False, False]


def test_dates(spark):
    df = spark.createDataFrame([(a, day(b)) for a, b in DATES], "x string, expected date")
    for r in df.select("x", "expected", P.parse_date(F.col("x")).alias("got")).collect():
        assert r.got == r.expected, r


def test_periods(spark):
    df = spark.createDataFrame([(a, day(b), day(c)) for a, b, c in PERIODS], "x string, s date, e date")
    for r in df.select("x", "s", "e", P.parse_period(F.col("x"), F.lit(3), F.lit(31)).alias("p")).collect():
        assert (r.p.start, r.p.end) == (r.s, r.e), r


def test_year_end(spark):
    phrases = [("a", "year ended 31 March 2024"), ("b", "fiscal ended 31 December 2023"), ("c", "year ended March 31, 2022"), ("d", "Q1 FY24"), ("e", None)]
    df = spark.createDataFrame(phrases, "fact_id string, period_raw string")
    assert tuple(learn_year_end(df).first()) == (3, 31)
    assert tuple(learn_year_end(df.where("false")).first()) == (12, 31)
    assert tuple(learn_year_end(df.where("fact_id < 'c'")).first()) == (3, 31)
