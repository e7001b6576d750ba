"""The date grammar: strings in, value and precision out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagechron.functions import months
from pagechron.functions.dates import detect_day_first, implausible_reason, parse_date, to_instant_ms
from pagechron.functions.text import collapse, fold

DAY = ("2024-03-12", "day")
CASES = [
    ("2023-04-11T10:30:00Z", "unknown", ("2023-04-11T10:30Z", "minute")),
    ("2023-04-11T10:30:00+02:00", "unknown", ("2023-04-11T10:30+02:00", "minute")),
    ("2023-04-11 10:30:00+0200", "unknown", ("2023-04-11T10:30+02:00", "minute")),
    ("2023-04-11T24:30:00Z", "unknown", None),
    ("2024", "unknown", ("2024", "year")),
    ("2024-03", "unknown", ("2024-03", "month")),
    ("2024-13", "unknown", None),
    ("2024-03-12", "unknown", DAY),
    ("Tue, 11 Apr 2023 10:00:00 GMT", "unknown", ("2023-04-11T10:00Z", "minute")),
    ("2023-02-30", "unknown", None),
    ("25/03/2024", "unknown", ("2024-03-25", "day")),
    ("03/25/2024", "unknown", ("2024-03-25", "day")),
    ("03/04/2024", "day-first", ("2024-04-03", "day")),
    ("03/04/2024", "month-first", ("2024-03-04", "day")),
    ("03/04/2024", "unknown", ("2024", "year")),
    ("04/04/2024", "unknown", ("2024-04-04", "day")),
    ("12 March 2024", "unknown", DAY),
    ("March 12, 2024", "unknown", DAY),
    ("12 marzo 2024", "unknown", DAY),
    ("3 dicembre 2021", "unknown", ("2021-12-03", "day")),
    ("12 février 2024", "unknown", ("2024-02-12", "day")),
    ("12 de marzo de 2024", "unknown", DAY),
    ("March 2024", "unknown", ("2024-03", "month")),
    ("November 1st, 2012", "unknown", ("2012-11-01", "day")),
    ("Nov 22nd, 2009", "unknown", ("2009-11-22", "day")),
    ("le 1er mars 2013", "unknown", ("2013-03-01", "day")),
    ("1º marzo 2013", "unknown", ("2013-03-01", "day")),
    ("3e januari 2014", "unknown", ("2014-01-03", "day")),
    ("19. Juli 2014", "unknown", ("2014-07-19", "day")),
    ("16.12.2012", "unknown", ("2012-12-16", "day")),
    ("2015.4.23", "unknown", ("2015-04-23", "day")),
    ("2015/4.23", "unknown", None),
    ("2024年3月12日", "month-first", DAY),
    ("2024년 3월 12일", "unknown", DAY),
    ("2024年3月", "unknown", ("2024-03", "month")),
    ("12 марта 2024", "unknown", DAY),
    ("12 березня 2024", "unknown", DAY),
    ("12 marca 2024", "unknown", DAY),
    ("12. března 2024", "unknown", DAY),
    ("12 Mayıs 2024", "unknown", ("2024-05-12", "day")),
    ("12 Μαρτίου 2024", "unknown", DAY),
    ("12. maaliskuuta 2024", "unknown", DAY),
    ("12 március 2024", "unknown", DAY),
    ("12 Maret 2024", "unknown", DAY),
    ("12 مارس 2024", "unknown", DAY),
    ("12 آذار 2024", "unknown", DAY),
    ("١٢ مارس ٢٠٢٤", "unknown", DAY),
    ("१२ मार्च २०२४", "unknown", DAY),
    ("12 מרץ 2024", "unknown", DAY),
    ("２０２４年３月１２日", "unknown", DAY),
    ("12 constructor 2024", "unknown", None),
    ("  2024-03-12 ", "unknown", DAY),
    ("", "unknown", None),
    (None, "unknown", None),
    ("no date 12345", "unknown", None),
]


def test_parse_date(spark):
    rows = spark.createDataFrame([(k, r, h) for k, (r, h, _) in enumerate(CASES)], "k int, raw string, hint string")
    got = {r.k: r.p and tuple(r.p) for r in rows.select("k", parse_date(F.col("raw"), F.col("hint")).alias("p")).collect()}
    assert {CASES[k][:2]: v for k, v in got.items()} == {(r, h): v for r, h, v in CASES}


def test_instants(spark):
    values = {"2024": 1704067200000, "2024-03": 1709251200000, "2023-04-11T10:30+02:00": 1681201800000, "2023-04-11T10:30": 1681209000000, "2024-13-45": None, "x": None}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", to_instant_ms(F.col("v")).alias("ms")).collect()
    assert {r.v: r.ms for r in rows} == values


@pytest.mark.parametrize(
    ("lang", "host", "hint"),
    [("en-US", None, "month-first"), ("en-GB", None, "day-first"), ("it", "example.com", "day-first"), ("en", "example.it", "day-first"), (None, "example.us", "month-first"), (None, "example.com", "unknown"), ("ja", None, "day-first")],
)
def test_detect_day_first(spark, lang, host, hint):
    row = spark.createDataFrame([(lang, host)], "lang string, host string").select(detect_day_first(F.col("lang"), F.col("host")).alias("h")).first()
    assert row.h == hint


def test_fold_and_collapse(spark):
    row = spark.createDataFrame([("Février ЙÀñ   x\n İ ok",)], "t string").select(fold(F.col("t")).alias("f"), collapse(F.col("t")).alias("c")).first()
    assert row.f == "fevrier иan   x\n i ok"
    assert row.c == "Février ЙÀñ x İ ok"


def test_plausibility(spark):
    cases = [("1994-12-31", "day", "before 1995"), ("2026-08-01", "day", "in the future"), ("2026-07-28T12:00Z", "minute", "looks like a render timestamp"), ("2026-07-28", "day", None), ("2026-07-28T12:01Z", "minute", None)]
    now = F.unix_millis(F.lit("2026-07-28 12:00:00").cast("timestamp"))
    rows = spark.createDataFrame(cases, "v string, p string, e string").select("v", "e", implausible_reason(F.col("v"), F.col("p"), now).alias("r")).collect()
    assert [r.r for r in rows] == [r.e for r in rows]


def test_month_names_are_those_that_were_checked(spark):
    """The names come from the JVM's locale data; another JVM's must be the same 333 names."""
    months.names.cache_clear()
    assert len(months.names()) == 333
    assert hashlib.sha256(months._table().encode()).hexdigest() == "9828c2ecb010fffe22bfc07c9b85c02b24be25794bf5cc65aee7659c996a7607"
