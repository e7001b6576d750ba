"""Chips, badges, notices, readouts; fetch policies; records as JSON lines."""

import json

import pytest
from pyspark.sql import functions as F

from pagechron.functions import display as D
from pagechron.functions.guard import may_fetch
from pagechron.operators.evaluate import stride
from pagechron.streaming import batch
from pagechron.types import CANDIDATE, CONFLICT

NOW = "2026-01-01"
PUBLISHED = ("2025-12-20", "day", "published", "opengraph", "declared", None)


def page(spark, published=PUBLISHED, kind=None):
    conflict = (kind, 40, "x", ("jsonld", "2001-01-01"), ("meta-date", "2002-01-01"), "2001-01-01", 3, "1999-01-01", None) if kind else None
    df = spark.createDataFrame([(published, None, conflict, [published] if published else [])], f"p {CANDIDATE}, m {CANDIDATE}, c {CONFLICT}, k array<{CANDIDATE}>")
    return df, F.lit(NOW).cast("timestamp")


def test_chip_and_badge(spark):
    df, now = page(spark)
    r = df.select(D.chip(F.col("p"), F.col("m"), F.col("c"), F.lit("fetch"), now).alias("a"), D.chip(F.col("p"), F.col("m"), F.col("c"), F.lit("url"), now).alias("b"), D.badge(F.col("p"), F.col("m"), F.col("c"), now).alias("g")).first()
    assert tuple(r.a) == ("12d", "declared", "Published: December 20, 2025 — stated by the site, Open Graph")
    assert tuple(r.b) == ("12d", "inferred", "Published: December 20, 2025 — inferred from the link address")
    assert tuple(r.g) == ("12d", "#0f766e", "2025-12-20 — stated by the site, Open Graph")
    df, now = page(spark, kind="predated-content")
    r = df.select(D.chip(F.col("p"), F.col("m"), F.col("c"), F.lit("fetch"), now).alias("a"), D.badge(F.col("p"), F.col("m"), F.col("c"), now).alias("g"), D.conflict_detail(F.col("c")).alias("d")).first()
    assert tuple(r.a) == ("!", "alert", "This page contradicts itself")
    assert tuple(r.g) == ("!", "#b3261e", "This page is probably older than it says")
    assert r.d.startswith("Declares 2001-01-01, but carries 3 dated elements from before then, back to 1999-01-01.")
    df, now = page(spark, published=None)
    r = df.select(D.chip(F.col("p"), F.col("m"), F.col("c"), F.lit("fetch"), now).alias("a"), D.badge(F.col("p"), F.col("m"), F.col("c"), now).alias("g")).first()
    assert r.a is None
    assert tuple(r.g) == ("?", "#4b5563", "No date found")


def test_toast_and_overlay(spark):
    df, now = page(spark)
    toast = lambda state: D.toast(F.lit(state), F.col("p"), F.col("m"), F.col("c"), F.lit("fetch"), F.lit("h.example"), now)
    r = df.select(toast("dated").alias("a"), toast("denied").alias("b"), D.overlay(F.col("p"), F.col("m"), F.col("c"), F.col("k"), now).alias("o"), D.overlay(F.col("p"), F.col("m"), F.col("c"), F.col("k"), now, "conflict").alias("n")).first()
    assert tuple(r.a) == ("Published: December 20, 2025", "h.example — stated by the site, Open Graph", "declared")
    assert tuple(r.b) == ("Permission to read that site was declined.", "For h.example", "muted")
    assert (r.o.age, r.o.tone, r.o.muted, r.o.label) == ("12 days ago", "normal", False, "Published 12 days ago. Published December 20, 2025 — stated by the site, Open Graph")
    assert r.n is None


def test_policies(spark):
    urls = spark.createDataFrame([("http://a.example/",), ("http://10.0.0.1/",), ("http://b.example/",), ("ftp://c.example/",)], "url string")
    dns = spark.createDataFrame([("a.example", "8.8.8.8"), ("b.example", "10.0.0.9")], "host string, address string")
    got = lambda *a: sorted(r.url for r in may_fetch(urls, *a).collect())
    assert got("off") == ["http://10.0.0.1/", "http://a.example/", "http://b.example/"]
    assert got("literal") == got("strict") == ["http://a.example/", "http://b.example/"]
    assert got("strict", dns) == ["http://a.example/"]
    with pytest.raises(ValueError, match="policy"):
        may_fetch(urls, "other")


def test_engine_keys_win_and_come_last(spark):
    lines = spark.createDataFrame([('{"url":"https://h.example/","published":"mine","tag":[1,"x"]}',), ("https://h.example/b",), ("nonsense",)], "value string")
    rows = batch.parse_lines(lines).withColumn("published", F.when(F.col("ok"), F.lit("2001-01-01")))
    got = [json.loads(r.value) for r in batch.to_ndjson(rows.select("extra", "url", "published", "error")).collect()]
    assert got[0] == {"tag": [1, "x"], "url": "https://h.example/", "published": "2001-01-01"}
    assert list(got[0])[0] == "tag"
    assert got[2] == {"error": "not an http(s) URL"}


def test_exit_status(spark):
    rows = spark.createDataFrame([(None, None, "unreachable")], "published string, modified string, error string")
    assert [rows.agg(batch.exit_status(rows, one).alias("s")).first().s for one in (False, True)] == [1, 2]
    assert rows.withColumn("published", F.lit("2001")).agg(batch.exit_status(rows).alias("s")).first().s == 0


def test_lines_keep_their_place_across_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(5000)) + "last")
    (tmp_path / "b.txt").write_text("only\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = batch.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r["index"], r.value) for r in rows if r.file.endswith("a.txt"))
    assert a == [*((k, f"line {k}") for k in range(5000)), (5000, "last")]
    assert sorted((r["index"], r.value) for r in rows if r.file.endswith("b.txt")) == [(0, "only"), (1, "")]


def test_stride_without_a_key(spark):
    rows = spark.range(1000).repartition(7)
    assert sorted(r.id for r in stride(rows, "id", 10).collect()) == list(range(0, 1000, 100))
    assert stride(rows.filter("id < 5"), "id", 10).count() == 5
