"""Lines, streams, caches and guards."""

import json
import time

import pytest
from pyspark.sql import functions as F

from pagechron.functions.guard import absolute, is_safe
from pagechron.plans.pipeline import find_dates
from pagechron.sources.side_documents import capped, elements, parse_xml
from pagechron.streaming import batch


@pytest.mark.parametrize(
    ("url", "safe"),
    [
        ("https://example.org/", True), ("http://8.8.8.8/", True), ("ftp://example.org/", False), ("file:///etc/passwd", False), ("http://localhost/", False), ("http://a.internal/", False),
        ("http://intranet/", False), ("http://127.0.0.1/", False), ("http://2130706433/", False), ("http://0x7f.1/", False), ("http://0177.0.0.1/", False), ("http://169.254.169.254/", False),
        ("http://172.31.0.1/", False), ("http://172.32.0.1/", True), ("http://[::1]/", False), ("http://[fd00::1]/", False), ("http://[::ffff:7f00:1]/", False), ("http://[64:ff9b::7f00:1]/", False),
        ("http://u:p@example.org/", False), ("http://", False), ("", False), (None, False),
    ],
)
def test_is_safe(url, safe):
    assert is_safe(url) is safe


def test_absolute():
    assert absolute("https://a.org/x/y", "../z") == "https://a.org/z"
    assert absolute("https://a.org/x", "//b.org") == "https://b.org/"
    assert absolute("https://a.org/x", None) is None


def test_parse_xml():
    assert parse_xml("<a><b/></a>").tag == "a"
    assert parse_xml("<a>") is None
    assert parse_xml('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>') is None
    assert parse_xml(None) is None
    assert parse_xml("<a><![CDATA[<!ENTITY x>]]></a>").text == "<!ENTITY x>"
    assert [e.tag for e in elements("<r><!-- <!ENTITY --><i>1</i><i>&unknown; 2</i>", ("i",))] == ["i", "i"]
    assert elements('<!DOCTYPE r [<!ENTITY x "<i>">]><r><i>&x;</i></r>', ("i",)) == []


def test_lines(spark, tmp_path):
    lines = ["https://a.org/1", "", "# note", "nope", '{"url":"https://a.org/2","id":7}', '{"id":1}', "{bad", "[1]"]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    rows = batch.parse_lines(batch.read_lines(spark, str(tmp_path / "in.txt"))).orderBy("index").collect()
    assert [(r["index"], r.ok, r.url, r.error) for r in rows] == [
        (0, True, "https://a.org/1", None),
        (3, False, None, "not an http(s) URL"),
        (4, True, "https://a.org/2", None),
        (5, False, None, 'missing or invalid "url"'),
        (6, False, None, "malformed JSON"),
        (7, False, None, "not an http(s) URL"),
    ]


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("https://a.org/2024/03/12/x\nhttps://a.org/missing\n")
    pages = spark.createDataFrame([(1, "https://a.org/2024/03/12/x", "<p>x</p>")], "page_id long, url string, html string")
    stream = batch.stream_records(batch.read_lines(spark, str(tmp_path / "in"), stream=True), pages, find_dates, F.lit("2026-01-01").cast("timestamp"))
    run = batch.to_ndjson(stream.select("url", "published", "error")).writeStream.format("text").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    got = {r["url"]: r for r in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect())}
    assert got["https://a.org/2024/03/12/x"]["published"]["value"] == "2024-03-12"
    assert got["https://a.org/missing"]["error"] == "unreachable"


def test_capped(spark):
    df = spark.createDataFrame([("abcdef", 3), ("abcdef", 99)], "b string, n int").select(capped(F.col("b"), F.col("n"), 4).alias("c"))
    assert [r.c for r in df.collect()] == ["abcd", None]


def test_hostile_pages_are_quick():
    from pagechron.sources.html import page_nodes

    start = time.time()
    list(page_nodes("<div>" * 12000, None, True))
    list(page_nodes("<meta name=date content=2024-01-01>" * 3000, None, True))
    list(page_nodes("<p>in 2024 we</p>" * 16000 + "<time datetime=2024-01-01>x</time>" * 2000, None, True))
    list(page_nodes("<script>" + "x='2024-01-01';" * 40000 + "</script>", None, True))
    assert time.time() - start < 20


def test_stream_without_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(f'{{"url":"u{k % 3}","at":"2024-01-0{k + 1}T00:00:00"}}\n' for k in range(5)))
    events = spark.readStream.schema("url string, at timestamp").json(str(tmp_path / "in"))
    run = batch.dedupe_stream(events, "url", "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u0", "u1", "u2"]
