"""Readers, writers and SQL access."""

import json

from pyspark.sql import functions as F

from pagechron.functions import sql
from pagechron.plans.pipeline import Options, find_dates
from pagechron.sources import files


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "a", "url": "https://a.org/", "label": {"published": "2024-01-02"}, "strata": {"host": "a.org"}}) + "\n\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.jsonl"))
    files.write_manifest(rows, str(tmp_path / "out"))
    files.write_manifest(rows, str(tmp_path / "out"))
    back = files.read_manifest(spark, str(tmp_path / "out")).collect()
    assert [(r.id, r.label.published, r.strata.host) for r in back] == [("a", "2024-01-02", "a.org")]


def test_seeds_and_cdx(spark, tmp_path):
    (tmp_path / "seeds").write_text("a.org # one\n\n#x\n b.org \na.org\n")
    seeds = files.read_seeds(spark, str(tmp_path / "seeds"))
    done = spark.createDataFrame([("b.org",)], "seed string")
    assert [r.seed for r in files.unseen(seeds, done).collect()] == ["a.org"]
    (tmp_path / "cdx").write_text('[["original","timestamp","statuscode","mimetype","digest","length"],\n["http://a/","20240101000000","200","text/html","D","12"]]\n')
    assert [(r.original, r.digest) for r in files.read_cdx(spark, str(tmp_path / "cdx")).collect()] == [("http://a/", "D")]


def test_page_folders(spark, tmp_path):
    page = tmp_path / "one"
    page.mkdir()
    (page / "expected.json").write_text(json.dumps({"url": "https://a.org/p", "fetchedFeedUrl": "https://a.org/feed.xml", "expect": {"published": "2024-01-02"}}))
    (page / "page.html").write_text("<html><head><link rel='alternate' type='application/rss+xml' href='/feed.xml'></head><body>x</body></html>")
    (page / "feed.xml").write_text("<rss><item><link>https://a.org/p/</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></rss>")
    (tmp_path / "two").mkdir()
    (tmp_path / "two/expected.json").write_text("{}")
    rows = files.read_page_folders(spark, str(tmp_path))
    assert [r.slug for r in rows.collect()] == ["one"]
    pages = rows.select(F.lit(1).alias("page_id"), "url", "html")
    got = find_dates(pages, F.lit("2026-01-01").cast("timestamp"), Options(documents=files.side_documents(rows))).first()
    assert (got.published.value, got.published.source) == ("2024-01-02T10:00Z", "rss-feed")


def test_helpers(spark):
    df = spark.createDataFrame([("https://www.A.org/b/c?d", "<meta http-equiv=refresh content=0>")], "u string, h string")
    row = df.select(files.slug_of(F.col("u")).alias("s"), files.is_redirect_stub(F.col("h")).alias("r")).first()
    assert (row.s, row.r) == ("a-org-b-c-d", True)


def test_sql(spark):
    sql.register(spark)
    assert spark.sql("SELECT is_safe_fetch_target('http://10.0.0.1/') AS a, absolute_url('https://a.org/x', 'y') AS b").first().asDict() == {"a": False, "b": "https://a.org/y"}
    assert spark.sql("SELECT kind FROM page_nodes('<meta name=date content=2024>', 'a.org') ORDER BY seq").collect()[1].kind == "meta"
    pages = spark.createDataFrame([(1, "https://a.org/2024/03/12/x", "<p>x</p>")], "page_id long, url string, html string")
    sql.create_views(pages, F.lit("2026-01-01").cast("timestamp"))
    assert spark.sql("SELECT published_value FROM page_dates").first()[0] == "2024-03-12"
    assert spark.sql("SELECT source FROM candidates").first()[0] == "url-slug"
    assert spark.sql("SELECT * FROM page_date('https://a.org/2024/03/12/x')").first()[:3] == ("2024-03-12", "url-slug", "inferred")
    assert spark.sql("SELECT text FROM page_date('https://a.org/2024/03/12/x')").first()[0].startswith("Page: https://a.org/2024/03/12/x\nPublished: 2024-03-12")
    assert spark.sql("SELECT * FROM page_date('https://a.org/other')").collect() == []
    fresh = lambda days: tuple(spark.sql(f"SELECT * FROM page_freshness('https://a.org/2024/03/12/x', {days})").first())
    assert fresh(700) == (False, "fresh", "2024-03-12", 659, 660) and fresh(600)[:2] == (True, "stale") and fresh(660)[:2] == (False, "fresh")
    assert spark.sql("SELECT reason FROM page_freshness('https://a.org/2024/03/12/x', 9, 'modified')").first()[0] == "no-date"
    assert [r.source for r in spark.sql("SELECT source FROM page_candidates('https://a.org/2024/03/12/x')").collect()] == ["url-slug"]
