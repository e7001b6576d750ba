"""Queries of the extractors, over pages rendered from the tables' dates, and over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.extract import extract
from ..sources.html import nodes
from ..sources.side_documents import build_stamped, last_modified
from . import pipeline
from .pipeline import Options, flat
from .registry import day, now, query, spread, table

D = "strftime(o_orderdate, '%Y-%m-%d')"


def _pages(spark, sf_dir, html, url=None):
    """One page per order."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    url = url if url is not None else F.concat(F.lit("https://h.example/p"), F.col("o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("page_id"), url.alias("url"), (html if hasattr(html, "alias") else F.lit(html)).alias("html"))


def _html(*parts):
    return F.concat(F.lit("<html><body>"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</body></html>"))


def _found(pages, mode="standard"):
    return extract(pages, mode).filter("value IS NOT NULL")


_META = ["article:published_time", "datePublished", "dc.date.issued", "citation_date", "parsely-pub-date", "pubdate", "vendor:updated_at", "x:published_date", "unknown_key", "date"]
_META_SQL = [("opengraph", "declared", "published"), ("itemprop", "declared", "published"), ("dublin-core", "derived", "published"), ("citation", "derived", "published"), ("parsely", "derived", "published"), ("meta-date", "derived", "published"), ("meta-date", "derived", "modified"), ("meta-date", "derived", "published"), None, ("meta-date", "derived", "unknown")]


@query(f"SELECT o_orderkey AS page_id, {D} AS value, source, confidence, field FROM (SELECT *, o_orderkey % 10 AS k FROM orders) JOIN (VALUES " + ", ".join(f"({k}, '{r[0]}', '{r[1]}', '{r[2]}')" for k, r in enumerate(_META_SQL) if r) + ") t(k, source, confidence, field) USING (k)")
def meta_rules(spark, sf_dir):
    key = F.element_at(F.array(*(F.lit(k) for k in _META)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    attr = F.when(F.col("o_orderkey") % 10 == 1, "itemprop").when(F.col("o_orderkey") % 2 == 0, "property").otherwise("name")
    rows = _found(_pages(spark, sf_dir, _html("<meta ", attr, '="', key, '" content=" ', day("o_orderdate"), ' ">')), "fast")
    return rows.select("page_id", "value", "source", "confidence", "field")


@query(
    f"""SELECT o_orderkey AS page_id, {D} AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'jsonld' ELSE 'jsonld-container' END AS source, 'published' AS field FROM orders
  UNION ALL SELECT o_orderkey, strftime(o_orderdate::DATE + 3, '%Y-%m-%d'), CASE WHEN o_orderkey % 2 = 0 THEN 'jsonld' ELSE 'jsonld-container' END, 'modified' FROM orders"""
)
def jsonld_walk(spark, sf_dir):
    """Dates in nested JSON-LD, typed as content or as a container."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "NewsArticle").otherwise("WebPage")
    node = F.concat(F.lit('{"@context":"x","@graph":[{"name":"n"},{"@type":["'), kind, F.lit('"],"datePublished":{"@value":"'), day("o_orderdate"), F.lit('"},"dateModified":["'), day(F.date_add(F.col("o_orderdate").cast("date"), 3)), F.lit('"]}]}'))
    rows = _found(_pages(spark, sf_dir, _html('<script type="application/ld+json">{broken</script><script type="application/ld+json">', node, "</script>")), "fast")
    return rows.select("page_id", "value", "source", "field")


@query(f"SELECT o_orderkey AS page_id, {D} AS value, CASE o_orderkey % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'modified' WHEN 2 THEN 'published' ELSE 'unknown' END AS field FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 4 = 2")
def time_tags(spark, sf_dir):
    """<time> read by its itemprop, its label or its markup; in navigation only where a nearer mark says so."""
    k = F.col("o_orderkey") % 4
    tag = F.concat(F.lit('<time dateTime="'), day("o_orderdate"), F.lit('"'), F.when(k == 0, ' itemprop="datePublished"').otherwise(""), F.lit(">x</time>"))
    inner = F.when(k == 1, F.concat(F.lit("<p>Last updated: "), tag, F.lit("</p>"))).when(k == 2, F.concat(F.lit('<div class="postMeta pubdate">'), tag, F.lit("</div>"))).otherwise(tag)
    outer = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("<nav>"), inner, F.lit("</nav>"))).otherwise(inner)
    return _found(_pages(spark, sf_dir, _html(outer)), "fast").select("page_id", "value", "field")


@query("SELECT CASE WHEN n > 5 THEN 'inferred' ELSE 'derived' END AS confidence, count(*) AS tags FROM (SELECT count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY confidence")
def listing_demotion(spark, sf_dir):
    """More than five unlabelled times on a page are a listing."""
    tags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit('<time datetime="'), day("l_shipdate"), F.lit('">x</time>'))), "").alias("t"))
    pages = tags.select(F.col("l_orderkey").alias("page_id"), F.lit("https://h.example/").alias("url"), _html(F.col("t")).alias("html"))
    return _found(pages, "fast").groupBy("confidence").agg(F.count("*").alias("tags"))


@query(f"SELECT o_orderkey AS page_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'wordpress' ELSE 'inline-state' END AS source, CASE WHEN o_orderkey % 3 = 2 THEN 'modified' ELSE 'published' END AS field FROM orders")
def inline_state(spark, sf_dir):
    key = F.element_at(F.array(F.lit("post_date_gmt"), F.lit("publishedAt"), F.lit("updated_at")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    stamp = F.concat(F.lit('"'), day("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit('"'))
    return _found(_pages(spark, sf_dir, _html('<script>window.s={"other":', stamp, ',"', key, '": ', stamp, ",", key, "=", stamp, "}</script>"))).select("page_id", "value", "source", "field")


@query(f"SELECT o_orderkey AS page_id, {D} AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE 'modified' END AS field FROM orders")
def marked_dates(spark, sf_dir):
    """Dates in markup whose class says so, in text or in the title."""
    mark = F.when(F.col("o_orderkey") % 2 == 0, "entry time").otherwise("last-updated")
    text = F.when(F.col("o_orderkey") % 4 < 2, day("o_orderdate", "d MMMM yyyy")).otherwise(F.concat(F.lit("2000 views"), F.lit("")))
    rows = _found(_pages(spark, sf_dir, _html('<div class="', mark, '" title="', day("o_orderdate"), '">', text, "</div>")))
    return rows.filter("source = 'marked-date'").select("page_id", "value", "field")


_LABELS = [("Published on ", "", "published"), ("Last updated: ", "", "modified"), ("Pubblicato il ", "", "published"), ("Zuletzt aktualisiert am ", "", "modified"), ("", " veröffentlicht", "published")]


@query(f"SELECT o_orderkey AS page_id, {D} AS value, CASE o_orderkey % 5 WHEN 1 THEN 'modified' WHEN 3 THEN 'modified' ELSE 'published' END AS field FROM orders")
def labelled_text(spark, sf_dir):
    """Dates beside a label, in several languages; after it, or before it in marked text."""
    k = (F.col("o_orderkey") % 5 + 1).cast("int")
    pick = lambda n: F.element_at(F.array(*(F.lit(x[n]) for x in _LABELS)), k)
    rows = _found(_pages(spark, sf_dir, _html('<p class="author">', pick(0), day("o_orderdate", "d.M.yyyy"), pick(1), "</p>")).withColumn("url", F.lit("https://h.example.de/")))
    return rows.filter("source = 'visible-text'").select("page_id", "value", "field")


@query("SELECT l_orderkey AS page_id, least(count(DISTINCT l_shipdate::DATE), 6) AS dates FROM lineitem GROUP BY l_orderkey")
def bare_text_cap(spark, sf_dir):
    """Unlabelled short dates, six to a page at most, none of them twice."""
    tags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<p>"), day("l_shipdate", "d MMM yyyy"), F.lit("</p>"))), "").alias("t"))
    pages = tags.select(F.col("l_orderkey").alias("page_id"), F.lit("https://h.example/").alias("url"), _html(F.col("t"), "<p>", F.repeat(F.lit("word "), 20), "1 May 1999</p><blockquote><p>2 May 1999</p></blockquote>").alias("html"))
    return _found(pages).groupBy("page_id").agg(F.count("*").alias("dates"))


@query("SELECT l_orderkey AS page_id, strftime(d, '%Y-%m-%d') AS value FROM (SELECT l_orderkey, l_shipdate::DATE AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_shipdate::DATE) AS k FROM lineitem GROUP BY l_orderkey, l_shipdate::DATE) WHERE k = 1")
def page_scan_mode(spark, sf_dir):
    """Of long blocks without anything else, the date shown most often."""
    tags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<p>"), F.repeat(F.lit("and "), 30), day("l_shipdate", "d MMMM yyyy"), F.repeat(F.lit(" then"), 30), F.lit("</p>"))), "").alias("t"))
    pages = tags.select(F.col("l_orderkey").alias("page_id"), F.lit("https://h.example/").alias("url"), _html(F.col("t")).alias("html"))
    return _found(pages, "extensive").select("page_id", "value")


@query("SELECT page_id, NULL::VARCHAR AS published_value, NULL::VARCHAR AS modified_value, 0::BIGINT AS n_candidates FROM pages")
def true_negative_pages(spark, sf_dir):
    """Pages that tell no date get none."""
    return flat(pipeline.find_dates(table(spark, sf_dir, "pages"), now())).select("page_id", "published_value", "modified_value", "n_candidates")


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang, 1::BIGINT AS page_rows FROM pages")
def page_nodes(spark, sf_dir):
    """The tokenizer's own row for each page, with its language."""
    return nodes(table(spark, sf_dir, "pages")).filter("kind = 'page'").groupBy("page_id").agg(F.first("lang").alias("lang"), F.count("*").alias("page_rows"))


@query(
    f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate::DATE + 5, '%Y-%m-%d') ELSE {D} END AS published_value,
  CASE o_orderkey % 4 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'opengraph' WHEN 2 THEN 'url-slug' ELSE 'visible-text' END AS published_source,
  CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate::DATE + 3, '%Y-%m-%d') END AS modified_value FROM orders"""
)
def find_dates_pages(spark, sf_dir):
    """The whole way: pages of four kinds to their dates."""
    return _flagship(spark, sf_dir).select("page_id", "published_value", "published_source", "modified_value")


def _flagship(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, day("o_orderdate")
    later = lambda n: day(F.date_add(F.col("o_orderdate").cast("date"), n))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"BlogPosting","datePublished":"'), d, F.lit('","dateModified":"'), later(3), F.lit('"}</script>'))
    og = F.concat(F.lit('<meta property="article:published_time" content="'), d, F.lit('">'))
    text = F.concat(F.lit("<p>Published on "), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 5), "MMMM d, yyyy"), F.lit(" by a writer</p>"))
    body = F.when(k == 0, ld).when(k == 1, og).when(k == 3, text).otherwise("<p>Nothing here</p>")
    url = F.when(k == 2, F.concat(F.lit("https://h.example/"), day("o_orderdate", "yyyy/MM/dd"), F.lit("/p"))).otherwise(F.concat(F.lit("https://h.example/p"), F.col("o_orderkey")))
    return flat(pipeline.find_dates(_pages(spark, sf_dir, _html(body), url), F.lit("2010-01-01").cast("timestamp")))


@query(
    f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate::DATE + 5, '%Y-%m-%d') ELSE {D} END AS published_value,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'declared' ELSE 'inferred' END AS published_confidence FROM orders"""
)
def find_dates(spark, sf_dir):
    """The flagship: pages to publication dates, with the evidence's tier."""
    return _flagship(spark, sf_dir).select("page_id", "published_value", "published_confidence")


def _documents(spark, sf_dir, kind):
    """Orders as pages of sites of some hundred pages each, so that sites grow in number with the table and documents don't grow."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).withColumn("site", F.expr("o_orderkey DIV 2000 * 2 + o_orderkey % 2"))
    d = day("o_orderdate")
    path = F.concat(F.lit("https://s"), F.col("site"), F.lit(".example/p"), F.col("o_orderkey"))
    if kind == "feed":
        item = F.when(F.col("site") % 2 == 0, F.concat(F.lit("<entry><link href='"), path, F.lit("/'/><published>"), d, F.lit("T08:00:00Z</published></entry>"))).otherwise(F.concat(F.lit("<item><link>"), path, F.lit("</link><pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 08:00:00 GMT</pubDate></item>")))
        name, head, tail = "/feed.xml", F.lit("<feed>"), F.lit("</feed>")
    else:
        item = F.concat(F.lit("<url><loc>"), path, F.lit("</loc><lastmod>"), d, F.lit("</lastmod></url>"))
        name, head, tail = "/pages.xml", F.lit("<urlset>"), F.lit("</urlset>")
    docs = orders.groupBy("site").agg(F.concat(head, F.array_join(F.collect_list(item), ""), tail).alias("body")).select(F.concat(F.lit("https://s"), F.col("site"), F.lit(".example"), F.lit(name)).alias("url"), "body", F.lit(None).cast("map<string,string>").alias("headers"))
    if kind == "sitemap":
        index = docs.select(F.regexp_replace("url", "/pages.xml", "/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>https://x.example/old.xml.gz</loc></sitemap><sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap></sitemapindex>")).alias("body"), "headers")
        docs = docs.unionByName(index)
    pages = orders.select(F.col("o_orderkey").alias("page_id"), path.alias("url"), F.lit("<html><head><link rel='canonical' href=''></head><body></body></html>").alias("html"))
    return pages, docs


@query(f"SELECT o_orderkey AS page_id, {D} || 'T08:00Z' AS published_value, CASE WHEN o_orderkey % 2 = 0 THEN 'atom-feed' ELSE 'rss-feed' END AS published_source FROM orders")
def feed_match(spark, sf_dir):
    """Pages to their entries in Atom and RSS feeds found by probing."""
    pages, docs = _documents(spark, sf_dir, "feed")
    return flat(pipeline.find_dates(pages, F.lit("2010-01-01").cast("timestamp"), Options(mode="fast", documents=docs, sitemap=False))).select("page_id", "published_value", "published_source")


@query(f"SELECT o_orderkey AS page_id, {D} AS modified_value, 'sitemap' AS modified_source FROM orders")
def sitemap_match(spark, sf_dir):
    """Pages to their dates in a sitemap behind an index."""
    pages, docs = _documents(spark, sf_dir, "sitemap")
    return flat(pipeline.find_dates(pages, F.lit("2010-01-01").cast("timestamp"), Options(mode="fast", documents=docs))).select("page_id", "modified_value", "modified_source")


@query("SELECT n_nationkey * 100 + k AS page_id, CASE WHEN k < 2 THEN strftime(DATE '2001-01-01' + (n_nationkey * 10 + k)::INT, '%Y-%m-%d') || 'T08:00Z' END AS published_value FROM nation, range(3) t(k)")
def feed_hot_paths(spark, sf_dir):
    """Many sites with the same paths, "/" and "/about": each page meets its own site's feed alone; a third page is in no feed."""
    sites = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("https://s"), F.col("n_nationkey"), F.lit(".example")).alias("site"))
    path = F.element_at(F.array(F.lit("/"), F.lit("/about"), F.lit("/index.html")), F.col("k") + 1)
    pages = sites.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("k"))).select((F.col("n_nationkey") * 100 + F.col("k")).alias("page_id"), F.concat("site", path).alias("url"), F.lit("<p>x</p>").alias("html"))
    stamp = lambda k: F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("n_nationkey") * 10 + k).cast("int")), "yyyy-MM-dd'T08:00:00Z'")
    entry = lambda path, k: F.concat(F.lit("<entry><link href='"), "site", F.lit(path), F.lit("'/><published>"), stamp(k), F.lit("</published></entry>"))
    docs = sites.select(F.concat("site", F.lit("/feed.xml")).alias("url"), F.concat(F.lit("<feed>"), entry("", 0), entry("/about/", 1), F.lit("</feed>")).alias("body"), F.lit(None).cast("map<string,string>").alias("headers"))
    return flat(pipeline.find_dates(pages, F.lit("2010-01-01").cast("timestamp"), Options(mode="fast", documents=docs, sitemap=False))).select("page_id", "published_value")


@query("SELECT n_nationkey AS page_id, strftime(DATE '2001-01-01' + n_nationkey::INT, '%Y-%m-%d') AS modified_value, 'sitemap' AS modified_source FROM nation")
def sitemap_canonical(spark, sf_dir):
    """Pages whose path is in no sitemap, but whose canonical URL is."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    right = F.concat(F.lit("https://h.example/right/"), F.col("n_nationkey"))
    pages = nations.select(F.col("n_nationkey").alias("page_id"), F.concat(F.lit("https://h.example/left?id="), F.col("n_nationkey")).alias("url"), F.concat(F.lit("<head><!-- <link rel=canonical href=/no> --><link rel=canonical href='"), right, F.lit("'></head>")).alias("html"))
    item = F.concat(F.lit("<url><loc>"), right, F.lit("</loc><lastmod>"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("n_nationkey").cast("int")).cast("string"), F.lit("</lastmod></url>"))
    docs = nations.agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(item), ""), F.lit("</urlset>")).alias("body")).select(F.lit("https://h.example/sitemap.xml").alias("url"), "body", F.lit(None).cast("map<string,string>").alias("headers"))
    return flat(pipeline.find_dates(pages, F.lit("2010-01-01").cast("timestamp"), Options(mode="fast", documents=docs))).select("page_id", "modified_value", "modified_source")


@query("SELECT o_orderkey AS page_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M') || 'Z' AS modified_value, 'http-last-modified' AS modified_source FROM orders")
def header_match(spark, sf_dir):
    """Pages that tell nothing, dated by their response's header."""
    pages = _pages(spark, sf_dir, "<p>x</p>")
    docs = _pages(spark, sf_dir, "").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), "o_orderdate"), "page_id")
    docs = docs.select("url", F.lit(None).cast("string").alias("body"), F.create_map(F.lit("Last-Modified"), day("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss' GMT'")).alias("headers"))
    return flat(pipeline.find_dates(pages, F.lit("2010-01-01").cast("timestamp"), Options(mode="fast", documents=docs, sitemap=False, http_headers=True))).select("page_id", "modified_value", "modified_source")


@query("SELECT 's' || (o_orderkey % 20) AS sitemap_url, count(*) AS entries, (count(*) >= 10 AND o_orderkey % 20 < 10) AS stamped FROM orders GROUP BY o_orderkey % 20")
def build_stamps(spark, sf_dir):
    """Sitemaps whose every date is the build's."""
    k = F.col("o_orderkey") % 20
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k).alias("sitemap_url"), F.lit("url").alias("kind"), F.when(k < 10, "1999-01-01").otherwise(F.concat(day("o_orderdate"), F.col("o_orderkey").cast("string"))).alias("lastmod"))
    return build_stamped(rows)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M') || 'Z' END AS value FROM events")
def last_modified_filter(spark, sf_dir):
    """Last-Modified kept only where it is no artefact of serving."""
    k = F.col("event_id") % 4
    stamp = lambda minutes: F.concat(day(F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + minutes * 60_000), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    headers = F.map_filter(
        F.create_map(F.lit("Last-Modified"), stamp(0), F.lit("Date"), F.when(k == 3, stamp(2)).otherwise(stamp(600)), F.lit("set-cookie"), F.when(k == 1, "a=b"), F.lit("Cache-Control"), F.when(k == 2, "private, max-age=0").otherwise("max-age=60")),
        lambda _, v: v.isNotNull(),
    )
    return spread(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", last_modified(headers, now())["value"].alias("value"))


@query(f"SELECT 'https://h.example/' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') || '/p' ELSE 'p' END || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'url' ELSE 'fetch' END AS tier, {D} AS value FROM orders WHERE o_orderkey % 4 <> 3")
def date_links(spark, sf_dir):
    """Links dated by their URL, else by their page; those that tell nothing left out."""
    dated = F.concat(F.lit("https://h.example/"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(day("o_orderdate", "yyyy/MM/dd"), F.lit("/p"))).otherwise("p"), F.col("o_orderkey"))
    html = F.when(F.col("o_orderkey") % 4 == 1, _html('<meta name="pubdate" content="', day("o_orderdate"), '">')).otherwise("<p>x</p>")
    pages = _pages(spark, sf_dir, html, dated)
    return pipeline.date_links(pages, pages, F.lit("2010-01-01").cast("timestamp"), Options(mode="fast")).select("url", "tier", "value")
