"""Pages to dates, and candidates to answers."""

import pytest
from pyspark.sql import functions as F

from pagechron.operators.extract import extract
from pagechron.plans.pipeline import Options, clear_adapters, find_dates, register_adapter
from pagechron.plans.resolve import resolve
from pagechron.types import CANDIDATE



def now():
    return F.lit("2026-07-29 00:00:00").cast("timestamp")


PAGES = {
    1: (
        "https://ex.org/2024/03/05/a",
        '<html lang="en"><head><meta property="article:published_time" content="2024-03-05T10:00:00Z"><script type="application/ld+json">'
        '{"@type":"NewsArticle","datePublished":"2024-03-04","dateModified":"2024-04-01T00:00:00Z"}</script></head><body><p>x</p></body></html>',
    ),
    2: ("https://ex.org/p", '<html lang="it"><body><article><p class="byline">Pubblicato il 12 marzo 2024</p></article></body></html>'),
    3: ("https://ex.org/q", '<html><body><div class="post-meta"><span class="date">March 3, 2020</span></div><p>Nothing 12345</p></body></html>'),
    4: ("https://ex.org/r", "<html><body><p>On 3 May 2019</p></body></html>"),
    5: ("https://ex.org/s", '<html><body><script>post_date="2020-01-01"</script></body></html>'),
    6: ("https://ex.org/t", None),
    7: ("https://ex.org/u", "<nav><p>3 May 2019</p></nav><blockquote><p>Published on 3 May 2019</p></blockquote><div class=sidebar><p>Published on 3 May 2019</p></div><p>unclosed <b>bold"),
    8: ("https://ex.org/v", "<p>" + "word " * 30 + "5 June 2018 " + "word " * 30 + "</p>"),
    9: ("", "<div>" * 3000 + "<p>Published on 1 May 2019</p>"),
}
EXPECTED = {
    "fast": {1: "2024-03-04"},
    "standard": {1: "2024-03-04", 2: "2024-03-12", 3: "2020-03-03", 4: "2019-05-03", 5: "2020-01-01", 9: "2019-05-01"},
    "extensive": {1: "2024-03-04", 2: "2024-03-12", 3: "2020-03-03", 4: "2019-05-03", 5: "2020-01-01", 7: "2019-05-03", 8: "2018-06-05", 9: "2019-05-01"},
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, *v) for k, v in PAGES.items()], "page_id long, url string, html string")


@pytest.mark.parametrize("mode", list(EXPECTED))
def test_modes(pages, mode):
    rows = find_dates(pages, now(), Options(mode=mode)).select("page_id", "published.value").collect()
    assert {r.page_id for r in rows} == set(PAGES)
    assert {r.page_id: r.value for r in rows if r.value} == EXPECTED[mode]


def test_min_confidence(pages):
    rows = find_dates(pages, now(), Options(min_confidence="declared")).filter("published IS NOT NULL").collect()
    assert [r.page_id for r in rows] == [1]


def test_unknown_mode(pages):
    with pytest.raises(ValueError, match="mode"):
        extract(pages, "slow")


def test_empty_table(spark, pages):
    assert find_dates(pages.limit(0), now()).count() == 0


def test_adapter(pages):
    register_adapter("a", F.col("page_id") == 6, lambda p: p.select("page_id", "url", F.lit("2001-02-03").alias("value"), F.lit("day").alias("precision"), F.lit("published").alias("field"), F.lit("declared").alias("confidence"), F.lit(None).cast("string").alias("note")))
    try:
        rows = find_dates(pages, now(), Options(mode="fast")).filter("page_id = 6").collect()
    finally:
        clear_adapters()
    assert rows[0].published.value == "2001-02-03"
    assert rows[0].published.source == "adapter"


def answer(spark, *candidates, archive=None, now="2026-07-28 12:00:00"):
    df = spark.createDataFrame([(1, [c + (None,) * (6 - len(c)) for c in candidates])], f"page_id long, candidates array<{CANDIDATE}>")
    return resolve(df, F.lit(now).cast("timestamp"), F.lit(archive)).first()


def test_tier_beats_precision(spark):
    r = answer(spark, ("2024-03-12T10:00Z", "minute", "published", "url-slug", "inferred"), ("2024", "year", "published", "jsonld", "declared"))
    assert r.published.value == "2024"


def test_first_of_equals_wins(spark):
    r = answer(spark, ("2024-03-12", "day", "published", "x", "derived"), ("2024-03-13", "day", "published", "y", "derived"))
    assert r.published.value == "2024-03-12"


def test_earliest_declared_within_30_days_of_the_running_best(spark):
    r = answer(spark, ("2024-03-30", "day", "published", "jsonld", "declared"), ("2024-03-05", "day", "published", "opengraph", "declared"), ("2024-02-10", "day", "published", "itemprop", "declared"))
    assert r.published.value == "2024-02-10"
    assert r.conflict.kind == "declared-disagreement"


def test_promotion_is_blocked_by_the_update(spark):
    r = answer(spark, ("2024-05-01", "day", "unknown", "time-tag", "derived"), ("2024-04-01", "day", "modified", "sitemap", "derived"))
    assert r.published is None
    assert r.modified.value == "2024-04-01"


def test_implausible_go(spark):
    r = answer(spark, ("1990-01-01", "day", "published", "jsonld", "declared"), ("2030-01-01", "day", "published", "jsonld", "declared"), ("2026-07-28T12:00Z", "minute", "published", "jsonld", "declared"))
    assert r.published is None
    assert r.candidates == []


def test_predated_content(spark):
    old = [(f"2015-01-0{k}", "day", "unknown", "time-tag", "derived") for k in (1, 2, 3)]
    r = answer(spark, ("2024-03-12", "day", "published", "jsonld", "declared"), *old)
    assert (r.conflict.kind, r.conflict.older_count, r.conflict.oldest) == ("predated-content", 3, "2015-01-01")


def test_stale_declaration(spark):
    r = answer(spark, ("2020-03-12", "day", "published", "jsonld", "declared"), archive="2024-01-01T00:00:00Z")
    assert (r.conflict.kind, r.conflict.archived) == ("stale-declaration", "2024-01-01")


def test_localised(spark):
    r = answer(spark, ("2024-03-13T03:00Z", "minute", "published", "jsonld", "declared"), ("2024-03-12T20:00", "minute", "unknown", "time-tag", "derived"))
    assert r.published.value == "2024-03-12T20:00-07:00"
    r = answer(spark, ("2024-03-13T03:00Z", "minute", "published", "jsonld", "declared"), ("2024-03-12", "day", "published", "visible-text", "inferred"))
    assert (r.published.value, r.published.precision) == ("2024-03-12", "day")


def test_no_candidates(spark):
    r = answer(spark)
    assert (r.published, r.modified, r.conflict, r.candidates) == (None, None, None, [])
