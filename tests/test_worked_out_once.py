"""What is dear is worked out once a row, however often it is used."""

from pyspark.sql import functions as F

from pagechron.functions import months
from pagechron.functions.dates import parse_date
from pagechron.functions.text import collapse
from pagechron.operators.evaluate import appears_in, renderings
from pagechron.operators.harvest import find_feeds
from pagechron.sources.side_documents import last_modified


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_written_forms_are_built_once(spark):
    df = spark.createDataFrame([("2001-02-03",), ("2001-2-3",), (None,)], "day string")
    forms = df.select("day", renderings(F.reverse(F.reverse("day")), F.array(F.lit("February"))).alias("forms"))
    assert plan(forms).count("reverse(reverse(") == 1
    got = {r.day: r.forms for r in forms.collect()}
    assert len(got["2001-02-03"]) == len(set(got["2001-02-03"])) > 90
    assert {"2001-02-03", "3/2/2001", "2001年2月3日", "February 3, 2001", "3. February 2001", "٢٠٠١-٠٢-٠٣", "February २००१"} <= set(got["2001-02-03"])


def test_only_forms_that_a_text_holds_become_patterns(spark):
    df = spark.createDataFrame([("on 3.2.2001!",), ("13.2.2001",), ("13.2.2001, 3.2.2001",), ("3.2.20010",), ("3x2x2001",), (None,)], "text string")
    seen = df.select(appears_in(F.col("text"), F.lit("3.2.2001")).alias("seen"))
    assert "Contains(text" in plan(seen) and [r.seen for r in seen.collect()] == [True, False, True, False, False, None]


def test_headers_and_dates_are_read_once(spark):
    rows = [
        (1, {"Last-Modified": "Tue, 02 Jan 2001 03:04:05 GMT"}), (2, {"last-modified": "Tue, 02 Jan 2001 03:04:05 GMT", "Date": "Tue, 02 Jan 2001 03:06:05 GMT"}), (3, {"Last-Modified": "Tue, 02 Jan 2001 03:04:05 GMT", "Set-Cookie": "a"}),
        (4, {"Last-Modified": "Tue, 02 Jan 2001 03:04:05 GMT", "Cache-Control": "no-store"}), (5, {"Last-Modified": "none"}), (6, {}), (7, None), (8, {"Last-Modified": "2 januari 2001", "date": "unknown"}),
    ]
    df = spark.createDataFrame(rows, "k int, headers map<string,string>")
    read = df.select("k", last_modified(F.map_concat("headers"), F.lit("2020-01-01").cast("timestamp"))["value"].alias("v"))
    assert plan(read).count("map_concat(headers") == 1
    assert {r.k: r.v for r in read.collect()} == {1: "2001-01-02T03:04Z", 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: "2001-01-02"}


def test_a_month_is_looked_up_where_a_name_was_found(spark):
    df = spark.createDataFrame([("3 März 2001",), ("Sept. 3, 2001",), ("le 1er août 2001",), ("3 มีนาคม ๒๐๐๑",), ("३ फरवरी २००१",), ("jan=01|feb 2001",), ("march",), (None,)], "x string")
    got = df.select("x", parse_date(F.col("x"))["value"].alias("v"))
    assert "|januari=01" not in plan(got)
    assert [r.v for r in got.collect()] == ["2001-03-03", "2001-09-03", "2001-08-01", None, "2001-02-03", "2001-02", None, None]


def test_texts_far_from_digits_are_left_out_and_dates_stay(spark):
    name = max(months.names(), key=len)
    texts = ["and " * 30 + "3 january 1996" + " then" * 30, f"{'q' * 90}{name}. 2001", f"31eme. de {name}. del 2001{'v' * 60}2 {name} 1999", "2001年 12 月 3 日" + "z" * 60 + "1/2/1999", "no digits", "7" + "x" * 70, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", months.near_digits(F.col("t")).alias("near"))
    body = F.lit(months.date_body())
    rows = df.select("t", "near", F.regexp_extract_all("t", body, F.lit(0)).alias("whole"), F.regexp_extract_all("near", body, F.lit(0)).alias("cut")).collect()
    assert [r.whole for r in rows] == [r.cut for r in rows] and [len(r.whole or "") for r in rows] == [1, 1, 2, 2, 0, 0, 0]
    assert len(rows[0].t) > 250 and len(rows[0].near) < 80


def test_texts_are_collapsed_where_they_need_it(spark):
    texts = ["a b", " a", "a ", "a  b", "a\tb", "a\n", "a b", "　a", "", "é x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(collapse(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["a b", "a", "a", "a b", "a b", "a", "a b", "a", "", "é x", None]


def test_sites_feeds_are_joined_without_the_driver(spark):
    homes = spark.createDataFrame([("a.example", None), ("b.example", "<link rel=alternate type=application/rss+xml href=/own.xml>"), ("c.example", None)], "host string, html string")
    probes = spark.createDataFrame([("https://a.example/rss", "<rss>"), ("https://a.example/feed", "no")], "url string, body string")
    found = find_feeds(homes, probes)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=merge)") == 2
    assert {r.host: r.feed for r in found.collect()} == {"a.example": "https://a.example/rss", "b.example": "https://b.example/own.xml", "c.example": None}
