"""Listings, sampling, discovery, resuming, cascades."""

import pytest
from pyspark.sql import functions as F

from pagechron.operators import cascade, harvest
from pagechron.sources.captures import collapse, land_captures, positions, read_captures, url_key

NOW = "2026-01-01"


def captures(spark, rows):
    return spark.createDataFrame([(*r, "text/html", "D", 1) for r in rows], "original string, timestamp string, statuscode string, mimetype string, digest string, length long")


def test_url_key(spark):
    urls = {"https://www.Example.org/A?b=1#c": "org,example)/a?b=1", "http://a.example.org:80": "org,example,a)/", "https://x.org?q": "org,x)?q", "ftp://www2.x.org/": "org,x)/"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == urls


def test_conditions_reach_the_scan(spark, tmp_path):
    rows = [(f"https://{h}.example/{k % 9}", f"20{10 + k % 10}0101000000", "200" if k % 3 else "404") for h in ("a", "ab", "b") for k in range(60)]
    land_captures(captures(spark, rows), f"file://{tmp_path}/c")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = read_captures(spark, f"file://{tmp_path}/c", "example,a)", "2012", "2016")
    plan = got._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThanOrEqual(urlkey,example,a))", "LessThan(urlkey,example,a*)", "GreaterThanOrEqual(timestamp,2012)", "LessThan(timestamp,2016)", "EqualTo(statuscode,200)", "EqualTo(mimetype,text/html)"):
        assert pushed in plan, pushed
    want = [r for r in rows if r[0].startswith("https://a.example/") and "2012" <= r[1] < "2016" and r[2] == "200"]
    assert sorted((r.original, r.timestamp) for r in got.collect()) == sorted(r[:2] for r in want)
    earliest = {}
    for u, t, _ in sorted(want, key=lambda r: r[1], reverse=True):
        earliest[u] = t
    assert {r.original: r.timestamp for r in collapse(got).collect()} == earliest


def test_positions_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), F.col("id") % 11)).alias("k"), F.hash("id").alias("o"), "id")
    got = positions(rows.repartition(7), ["k"], ["o", "id"])
    assert got.columns == ["k", "o", "id", "_at", "_of"]
    by_key = {}
    for r in got.collect():
        by_key.setdefault(r.k, []).append((r["_at"], r.o, r.id, r["_of"]))
    assert sum(map(len, by_key.values())) == 5000
    for own in by_key.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and {x[3] for x in own} == {len(own)}
        assert [x[1:3] for x in own] == sorted(x[1:3] for x in own)


def test_sample_points():
    points = harvest.sample_points()
    assert len(points) == 16 and points[:4] == [(2006, 1, 0.0), (2006, 7, pytest.approx(0.618)), (2009, 6, pytest.approx(0.236)), (2009, 12, pytest.approx(0.854))]
    assert all(1 <= m <= 12 for _, m, _ in points)


def test_short_months_only_where_there_are_no_long_ones(spark):
    rows = [("a", "/2006/01/x"), ("a", "/2006/1/y"), ("b", "/2006/1/z"), ("b", "/2006/12/w"), ("c", "/2007/01/v"), (None, "/2006/01/n")]
    got = harvest.sampled_quota(spark.createDataFrame([(d, p, p) for d, p in rows], "domain string, path string, urlkey string"), 16).collect()
    assert sorted((r.domain or "", r.path) for r in got) == [("", "/2006/01/n"), ("a", "/2006/01/x"), ("b", "/2006/1/z")]


def test_feeds(spark):
    homes = spark.createDataFrame([("a.example/blog", "<link rel=alternate type=text/xml href=f.xml>"), ("b.example", None), ("c.example", "<link rel=alternate type=text/html href=x>"), ("d.example", "<p>")], "host string, html string")
    probes = spark.createDataFrame([("https://b.example/rss", "<rss>"), ("https://b.example/feed", "<feeds>"), ("https://c.example/feed/", "<RDF:rdf xmlns=x>"), ("https://c.example/feed.xml", "<feed>"), ("https://d.example/rss", None)], "url string, body string")
    got = {r.host: r.feed for r in harvest.find_feeds(homes, probes).collect()}
    assert got == {"a.example/blog": "https://a.example/f.xml", "b.example": "https://b.example/rss", "c.example": "https://c.example/feed/", "d.example": None}


def test_a_killed_harvest_goes_on(spark, tmp_path):
    """Killed between its entries and its ledger, and run again: the same rows as without."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text("".join(f"s{(7 * k + j) % 12}\n" for j in range(8)))
    ledger, entries = f"file://{tmp_path}/ledger", f"file://{tmp_path}/entries"
    seeds = spark.readStream.option("maxFilesPerTrigger", "1").text(f"file://{tmp_path}/in").withColumnRenamed("value", "seed")
    asked = []

    def find(todo):
        asked.append(sorted(r.seed for r in todo.collect()))
        return todo.select("seed", F.concat("seed", F.lit("/page")).alias("url"), (F.col("seed") == "s5").alias("failed"))

    work = harvest.resumable(seeds, ledger, find, entries)

    def killed(batch, number):
        if number == 1 and len(asked) < 2:
            find(batch).write.parquet(f"{entries}/batch=1")  # entries are out, the ledger isn't
            raise RuntimeError("killed")
        work(batch, number)

    def run():
        q = seeds.writeStream.foreachBatch(killed).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    found = spark.read.parquet(entries).filter("NOT failed")
    urls = [r.url for r in found.collect()]
    assert sorted(urls) == sorted({f"s{k}/page" for k in range(12)} - {"s5/page"})  # none twice, none lost
    assert {r.seed for r in harvest.read_ledger(spark, ledger).collect()} == {f"s{k}" for k in range(12)} - {"s5"}
    assert sum("s5" in a for a in asked) > 1  # what has failed is tried again


def test_heads(spark):
    pages = ["<html><HEAD>a</head >b", "<p>x<body class=y>z", "<p>no head", None, "x" * (cascade.HEAD_CHARS + 5)]
    got = [r.h for r in spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, p string").select("k", cascade.head_of(F.col("p")).alias("h")).orderBy("k").collect()]
    assert got == ["<html><HEAD>a</head >", "<p>x", "<p>no head", None, "x" * cascade.HEAD_CHARS]


def test_settled_pages_never_reach_the_texts(spark, monkeypatch):
    declared = '<head><meta property="article:published_time" content="2024-03-01"></head><p>Published on March 9, 2024</p>'
    pages = spark.createDataFrame([(1, "https://h.example/1", declared), (2, "https://h.example/2", "<head></head><p>Published on March 5, 2024</p>"), (3, None, None)], "page_id long, url string, html string")
    whole = []
    real = cascade.find_dates
    monkeypatch.setattr(cascade, "find_dates", lambda p, *a: (whole.append(p), real(p, *a))[1])
    got = {r.page_id: (r.published and r.published.value, r.settled) for r in cascade.early_exit(pages, F.lit(NOW).cast("timestamp")).collect()}
    assert got[1] == ("2024-03-01", "head") and got[2] == ("2024-03-05", "full")
    assert sorted(r.page_id for r in whole[1].collect()) == [2, 3]


def test_modes_are_timed(spark):
    pages = spark.createDataFrame([(k, f"https://h.example/{k}", "<p>Published on March 5, 2024</p>") for k in range(5)], "page_id long, url string, html string")
    gold = pages.select("page_id", F.lit("2024-03-05").alias("gold"))
    rows = {r["mode"]: r for r in cascade.timed_modes(pages, gold, F.lit(NOW).cast("timestamp"), rounds=1)}
    assert {m: (r["pages"], r["exact"], r["missed"]) for m, r in rows.items()} == {"fast": (5, 0, 5), "standard": (5, 5, 0), "extensive": (5, 5, 0)}
    assert all(r["ms_per_page"] > 0 for r in rows.values())
