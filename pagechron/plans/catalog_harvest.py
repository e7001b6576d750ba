"""Queries of capture listings, sampling, feeds, cascades, modes, untrusted answers and what readers are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as shown
from ..functions.guard import may_fetch
from ..functions.locales import LANGUAGES, MONTHS, display_in
from ..functions.reads import accept_link_read, accept_page_read
from ..functions.sql import create_views
from ..functions.verdicts import source_label
from ..operators import cascade, harvest
from ..operators.evaluate import result_hosts, search_engine
from ..sources.captures import collapse, land_captures, read_captures
from ..sources.scratch import scratch
from ..streaming import batch
from ..types import CANDIDATE, CONFLICT
from .catalog_extract import D
from .registry import day, now, query, spread, table

_HOSTS = "CASE WHEN l_orderkey % 2 = 0 THEN 'hot.example' ELSE 'd' || (l_suppkey % 40) || '.example' END"
_STATUS = "CASE l_linenumber % 4 WHEN 0 THEN '404' WHEN 1 THEN '301' ELSE '200' END"


def _captures(spark, sf_dir):
    """A capture for each line: half of them of one site, several of most addresses."""
    rows = table(spark, sf_dir, "lineitem")
    url = F.concat(F.lit("https://www."), F.expr(_HOSTS), F.lit("/"), F.date_format("l_shipdate", "yyyy/MM"), F.lit("/p"), (F.col("l_orderkey") % 1000).cast("string"))
    return rows.select(url.alias("original"), F.date_format("l_shipdate", "yyyyMMdd000000").alias("timestamp"), F.expr(_STATUS).alias("statuscode"), F.when(F.col("l_linenumber") % 5 == 0, "image/png").otherwise("text/html").alias("mimetype"), F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("digest"), F.col("l_quantity").cast("long").alias("length"))


def _landed(spark, sf_dir):
    path = scratch(spark, "captures")
    land_captures(_captures(spark, sf_dir), path)
    return path


_CAPTURES = f"(SELECT {_HOSTS} AS host, 'https://www.' || {_HOSTS} || '/' || strftime(l_shipdate, '%Y/%m') || '/p' || (l_orderkey % 1000) AS original, strftime(l_shipdate, '%Y%m%d000000') AS timestamp, {_STATUS} AS statuscode, CASE WHEN l_linenumber % 5 = 0 THEN 'image/png' ELSE 'text/html' END AS mimetype, l_orderkey || '-' || l_linenumber AS digest FROM lineitem)"


@query(f"SELECT original, min(timestamp) AS timestamp FROM {_CAPTURES} WHERE host = 'hot.example' AND statuscode = '200' AND mimetype = 'text/html' AND timestamp >= '1994' AND timestamp < '1997' GROUP BY original")
def capture_listing(spark, sf_dir):
    """One site's captures of some years from a landed listing, the earliest of each address."""
    rows = read_captures(spark, _landed(spark, sf_dir), "example,hot)", "1994", "1997")
    return collapse(rows).select("original", "timestamp")


@query(f"SELECT original, substr(timestamp, 1, 4) AS year, min(timestamp) AS timestamp, count(*) AS captures FROM {_CAPTURES} GROUP BY ALL")
def capture_years(spark, sf_dir):
    """Every address once a year, whatever its state."""
    rows = read_captures(spark, _landed(spark, sf_dir), status=None, mime=None)
    first = collapse(rows, 4).select("urlkey", "original", F.left("timestamp", F.lit(4)).alias("year"), "timestamp")
    many = rows.groupBy("urlkey", F.left("timestamp", F.lit(4)).alias("year")).agg(F.count("*").alias("captures"))
    return first.join(many, ["urlkey", "year"]).drop("urlkey")


_YEARS = tuple(range(1992, 2000))
_POINTS = ", ".join(f"({k}, '{y}/{m:02d}', {p!r}::DOUBLE)" for k, (y, m, p) in enumerate(harvest.sample_points(_YEARS)))


@query(
    f"""WITH c AS (SELECT host, original || '/' || digest AS url, strftime(strptime(substr(timestamp, 1, 8), '%Y%m%d'), '%Y/%m') AS m FROM {_CAPTURES}
), p AS (SELECT host, url, k, phase, row_number() OVER (PARTITION BY host, k ORDER BY url) - 1 AS place, least(count(*) OVER (PARTITION BY host, k), 1500) AS n FROM c JOIN (VALUES {_POINTS}) t(k, month, phase) ON c.m = t.month
) SELECT host AS domain, k AS point, url FROM p WHERE place < 1500 AND (n <= 4 OR list_contains(list_transform(range(4), lambda i: CAST(floor((i + phase) * (n / 4)) AS BIGINT) % n), place))"""
)
def sampled_quota(spark, sf_dir):
    """Four addresses from each of sixteen months of every domain, one of which has half of all rows."""
    rows = _captures(spark, sf_dir).select(F.regexp_extract("original", "www\\.([^/]+)", 1).alias("domain"), F.regexp_extract("original", "^https://[^/]+(.*)$", 1).alias("path"), F.concat("original", F.lit("/"), "digest").alias("url"))
    return harvest.sampled_quota(rows, 64, _YEARS, order="url").select("domain", F.col("point").cast("int").alias("point"), "url")


@query(
    """SELECT 'c' || c_custkey || '.example' AS host, CASE WHEN c_custkey % 4 = 0 THEN 'https://c' || c_custkey || '.example/own.xml' WHEN c_custkey % 4 = 3 THEN NULL
  WHEN c_custkey % 3 = 0 THEN 'https://c' || c_custkey || '.example/rss' ELSE 'https://c' || c_custkey || '.example/atom.xml' END AS feed FROM customer"""
)
def feed_discovery(spark, sf_dir):
    """A site's declared feed, else the first usual path that answers with one."""
    k = F.col("c_custkey")
    host = F.concat(F.lit("c"), k, F.lit(".example"))
    declared = F.when(k % 4 == 0, '<link rel="stylesheet alternate" type="application/rss+xml" href="/own.xml"><link rel=alternate type=application/atom+xml href=/other.xml>').otherwise('<link rel="alternate" hreflang="de" href="/de">')
    sites = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    homes = sites.select(host.alias("host"), F.when(k % 2 == 0, F.concat(F.lit("<html><head>"), declared, F.lit("</head></html>"))).alias("html"))
    at = lambda path, body: sites.filter("c_custkey % 4 != 3").select(F.concat(F.lit("https://"), host, F.lit(path)).alias("url"), body.alias("body"))
    probes = at("/feed", F.lit("<html>not found</html>")).union(at("/rss", F.when(k % 3 == 0, "<?xml?><RSS version='2.0'>"))).union(at("/atom.xml", F.lit("<feed xmlns='a'>"))).union(at("/feed.xml", F.lit("<feed>")))
    return harvest.find_feeds(homes, probes)


def _mixed_pages(spark, sf_dir):
    """Pages that tell their date in the head, in the body's data, in text, in an address or not at all."""
    k, d = F.col("o_orderkey") % 5, day("o_orderdate")
    head = F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="'), d, F.lit('">'))).otherwise("<title>x</title>")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"BlogPosting","datePublished":"'), d, F.lit('"}</script>'))
    text = F.concat(F.lit("<p>Published on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" by a writer</p>"))
    url = F.concat(F.lit("https://h.example/"), F.when(k == 3, day("o_orderdate", "yyyy/MM/dd/")).otherwise(""), F.lit("p"), F.col("o_orderkey"))
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), F.when(k == 1, ld).when(k == 2, text).otherwise("<p>Nothing here</p>"), F.lit("</body></html>"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(F.col("o_orderkey").alias("page_id"), url.alias("url"), html.alias("html"))


def _gold(spark, sf_dir):
    """The true days; every seventh is another than the page tells."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderkey") % 7 == 0, day(F.date_add(d, 400))).otherwise(day("o_orderdate")).alias("gold"))


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 < 4 THEN {D} END AS published_value, CASE WHEN o_orderkey % 5 = 0 THEN 'head' ELSE 'full' END AS settled FROM orders")
def early_exit(spark, sf_dir):
    """What heads declare settles a fifth of all pages; the others are read whole."""
    return cascade.early_exit(_mixed_pages(spark, sf_dir), now()).select("page_id", F.col("published.value").alias("published_value"), "settled")


@query(
    """SELECT count(*) AS pages, count(*) FILTER (WHERE k = 0) AS settled, count(*) FILTER (WHERE k = 0) AS alike, 0::BIGINT AS different, count(*) FILTER (WHERE k < 4 AND is_right) AS hits_full,
  count(*) FILTER (WHERE k < 4 AND is_right) AS hits_early_exit FROM (SELECT o_orderkey % 5 AS k, o_orderkey % 7 <> 0 AS is_right FROM orders)"""
)
def early_exit_report(spark, sf_dir):
    """Exact hits of reading all pages whole and of leaving early."""
    return cascade.early_exit_report(_mixed_pages(spark, sf_dir), _gold(spark, sf_dir), now())


@query(
    """SELECT mode, count(*) AS pages, count(*) FILTER (WHERE told) AS candidates, count(*) FILTER (WHERE told AND is_right) AS exact, 0::BIGINT AS partial, count(*) FILTER (WHERE told AND NOT is_right) AS wrong, count(*) FILTER (WHERE NOT told) AS missed
  FROM (SELECT mode, k < 4 AND (k <> 2 OR mode <> 'fast') AS told, is_right FROM (SELECT o_orderkey % 5 AS k, o_orderkey % 7 <> 0 AS is_right FROM orders), (VALUES ('fast'), ('standard'), ('extensive')) m(mode)) GROUP BY mode"""
)
def modes_table(spark, sf_dir):
    """What each mode finds on the same pages; what it takes is timed by the same module."""
    return cascade.modes_table(_mixed_pages(spark, sf_dir), _gold(spark, sf_dir), now())


def _sql_pages(spark, sf_dir, prefix):
    create_views(_mixed_pages(spark, sf_dir), now(), prefix=prefix)
    table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", f"concat('https://h.example/', CASE WHEN o_orderkey % 5 = 3 THEN date_format(o_orderdate, 'yyyy/MM/dd/') ELSE '' END, 'p', o_orderkey) AS url").createOrReplaceTempView(f"{prefix}asked")


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 < 4 THEN {D} END AS published, CASE o_orderkey % 5 WHEN 0 THEN 'opengraph' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'visible-text' WHEN 3 THEN 'url-slug' END AS published_source FROM orders")
def sql_page_date(spark, sf_dir):
    """A table function beside each row of a query: one join."""
    _sql_pages(spark, sf_dir, "d_")
    return spark.sql("SELECT a.page_id, t.published, t.published_source FROM d_asked a, LATERAL d_page_date(a.url) t")


@query("SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 > 3 THEN 'no-date' WHEN date_diff('day', o_orderdate::DATE, DATE '2002-01-01') <= 2000 THEN 'fresh' ELSE 'stale' END AS reason FROM orders")
def sql_page_freshness(spark, sf_dir):
    """Whether each page is younger than 2,000 days, in SQL."""
    _sql_pages(spark, sf_dir, "f_")
    return spark.sql("SELECT a.page_id, t.reason FROM f_asked a, LATERAL f_page_freshness(a.url, 2000, 'published') t")


_GOOD = '{"value":"%s","precision":"day","field":"published","source":"jsonld","confidence":"declared","note":null,"more":1}'
#: Answers of a script, by the order's key: only the first three are to be trusted.
_READS = [
    '{"href":"https://h.example/%d","candidates":[@]}', '{"href":"https://h.example/%d#part","candidates":[@,@]}', '{"href":"https://h.example/%d","candidates":[]}', '{"href":"https://h.example/%d","candidates":{"0":@}}', '{"href":7,"candidates":[@]}',
    '{"href":"https://h.example/other%d","candidates":[@]}', '{"href":"https://h.example/%d","candidates":[@,{"value":20240101}]}', '{"href":"https://h.example/%d","candidates":[@,null]}', '["https://h.example/%d"]', '"https://h.example/%d"', "null",
]


def _reads(spark, sf_dir, name):
    k, url = F.col("o_orderkey"), F.format_string("https://h.example/%d", "o_orderkey")
    made = [F.replace(F.format_string(r.replace("href", name), k) if "%d" in r else F.lit(r), F.lit("@"), F.format_string(_GOOD, day("o_orderdate"))) for r in _READS]
    read = F.parse_json(F.element_at(F.array(*made), (k % len(_READS) + 1).cast("int")))
    return table(spark, sf_dir, "orders").select(k.alias("page_id"), read.alias("read"), url.alias("expected"))


_ACCEPTED = f"SELECT o_orderkey AS page_id, CASE o_orderkey % {len(_READS)} {{}} END AS n, CASE WHEN o_orderkey % {len(_READS)} IN ({{}}) THEN {D} END AS value FROM orders"


@query(_ACCEPTED.format("WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0", "0, 1"))
def accept_page_reads(spark, sf_dir):
    """Answers of page scripts with planted faults; one bad candidate spoils its answer."""
    got = accept_page_read(F.col("read"), F.col("expected"))
    return _reads(spark, sf_dir, "href").select("page_id", F.when(got.isNotNull(), F.size(got)).alias("n"), F.get(got, F.lit(0))["value"].alias("value"))


@query(_ACCEPTED.format("WHEN 0 THEN 1 WHEN 2 THEN 0", "0"))
def accept_link_reads(spark, sf_dir):
    """The same of link scripts, which must echo the very URL they were asked for."""
    got = accept_link_read(F.col("read"), F.col("expected"))
    return _reads(spark, sf_dir, "url").select("page_id", F.when(got.isNotNull(), F.size(got)).alias("n"), F.get(got, F.lit(0))["value"].alias("value"))


_DAY_SQL = {"de": "d || '. ' || m || ' ' || y", "es": "d || ' de ' || m || ' de ' || y", "fr": "d || ' ' || m || ' ' || y", "it": "d || ' ' || m || ' ' || y", "pt": "d || ' de ' || m || ' de ' || y"}
_MONTH_SQL = {"de": "m || ' ' || y", "es": "m || ' de ' || y", "fr": "m || ' ' || y", "it": "m || ' ' || y", "pt": "m || ' de ' || y"}
_NAMES_SQL = " ".join(f"WHEN {k} THEN [{', '.join(repr(m) for m in MONTHS[t])}][month(o_orderdate)]" for k, t in enumerate(LANGUAGES) if t in MONTHS)


@query(
    f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 3 THEN y::VARCHAR WHEN o_orderkey % 4 = 2 THEN CASE k WHEN 0 THEN strftime(o_orderdate, '%B %Y') {' '.join(f'WHEN {LANGUAGES.index(t)} THEN {s}' for t, s in _MONTH_SQL.items())} END
  ELSE CASE k WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') {' '.join(f'WHEN {LANGUAGES.index(t)} THEN {s}' for t, s in _DAY_SQL.items())} END END AS shown
  FROM (SELECT *, o_orderkey % {len(LANGUAGES)} AS k, day(o_orderdate) AS d, year(o_orderdate) AS y, CASE o_orderkey % {len(LANGUAGES)} {_NAMES_SQL} END AS m FROM orders)"""
)
def display_languages(spark, sf_dir):
    """Days, months and years in six languages."""
    k = F.col("o_orderkey") % 4
    precision = F.when(k == 3, "year").when(k == 2, "month").otherwise("day")
    value = F.when(k == 3, day("o_orderdate", "yyyy")).when(k == 2, day("o_orderdate", "yyyy-MM")).otherwise(day("o_orderdate"))
    tag = F.element_at(F.array(*(F.lit(f"{t}-XX" if i % 2 else t.upper()) for i, t in enumerate(LANGUAGES))), (F.col("o_orderkey") % len(LANGUAGES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), display_in(value, precision, tag).alias("shown"))


_TIERS = ("declared", "derived", "inferred")


def _shown_pages(spark, sf_dir):
    """Orders as dated pages: every fifth contradicts itself, every seventh has no date."""
    k = F.col("o_orderkey")
    tier = F.element_at(F.array(*map(F.lit, _TIERS)), (k % 3 + 1).cast("int"))
    date = F.when(k % 7 != 0, F.struct(day("o_orderdate").alias("value"), F.lit("day").alias("precision"), F.lit("published").alias("field"), F.lit("opengraph").alias("source"), tier.alias("confidence"), F.lit(None).cast("string").alias("note"))).cast(CANDIDATE)
    conflict = F.when((k % 5 == 0) & (k % 7 != 0), F.from_json(F.lit('{"kind":"predated-content","gap_days":400,"declared":"2001-01-01","older_count":3,"oldest":"1999-01-01"}'), CONFLICT))
    rows = table(spark, sf_dir, "orders").select(k.alias("page_id"), date.alias("p"), F.lit(None).cast(CANDIDATE).alias("m"), conflict.alias("c"))
    return rows.withColumn("all", F.array_compact(F.array("p")))


_STATE_SQL = "CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'dated' END"
_TIER_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'derived' ELSE 'inferred' END"
_SAYS_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'stated by the site' WHEN 1 THEN 'from page markup' ELSE 'inferred' END || ', Open Graph'"
_LONG_SQL = "strftime(o_orderdate, '%B %-d, %Y')"


@query(
    f"""SELECT o_orderkey AS page_id, CASE {_STATE_SQL} WHEN 'conflict' THEN 'alert' WHEN 'dated' THEN {_TIER_SQL} END AS tone,
  CASE {_STATE_SQL} WHEN 'conflict' THEN 'This page contradicts itself' WHEN 'dated' THEN 'Published: ' || {_LONG_SQL} || ' — ' || {_SAYS_SQL} END AS title FROM orders"""
)
def chips(spark, sf_dir):
    c = shown.chip(F.col("p"), F.col("m"), F.col("c"), F.lit("fetch"), now())
    return _shown_pages(spark, sf_dir).select("page_id", c["tone"].alias("tone"), c["title"].alias("title"))


@query(
    f"""SELECT o_orderkey AS page_id, CASE {_STATE_SQL} WHEN 'none' THEN '#4b5563' WHEN 'conflict' THEN '#b3261e' ELSE CASE o_orderkey % 3 WHEN 0 THEN '#0f766e' WHEN 1 THEN '#c2410c' ELSE '#6b7280' END END AS colour,
  CASE {_STATE_SQL} WHEN 'none' THEN 'No date found' WHEN 'conflict' THEN 'This page is probably older than it says' ELSE {D} || ' — ' || {_SAYS_SQL} END AS title FROM orders"""
)
def badges(spark, sf_dir):
    b = shown.badge(F.col("p"), F.col("m"), F.col("c"), now())
    return _shown_pages(spark, sf_dir).select("page_id", b["colour"].alias("colour"), b["title"].alias("title"))


@query(
    f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Permission to read that site was declined.' WHEN o_orderkey % 7 = 0 THEN 'No date found for this link.' ELSE 'Published: ' || {_LONG_SQL} END AS heading,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 THEN 'For h.example' ELSE 'h.example — ' || {_SAYS_SQL} END AS detail,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 THEN 'muted' WHEN o_orderkey % 5 = 0 THEN 'alert' ELSE {_TIER_SQL} END AS tone FROM orders"""
)
def toasts(spark, sf_dir):
    """What a reader is told about a link: declined, without a date, or dated."""
    state = F.when(F.col("page_id") % 4 == 0, "denied").when(F.col("p").isNull(), "none").otherwise("dated")
    t = shown.toast(state, F.col("p"), F.col("m"), F.col("c"), F.lit("fetch"), F.lit("h.example"), now())
    return _shown_pages(spark, sf_dir).select("page_id", *(t[f].alias(f) for f in ("heading", "detail", "tone")))


@query(
    f"""SELECT o_orderkey AS page_id, o_orderkey % 7 = 0 AS muted, CASE WHEN o_orderkey % 7 = 0 THEN 'No date found. That is sometimes the correct answer — this page may genuinely not state when it was written.' ELSE 'Published ' || {_LONG_SQL} || ' — ' || {_SAYS_SQL} END AS detail,
  CASE WHEN {_STATE_SQL} = 'conflict' THEN 'This page is probably older than it says' END AS conflict, CASE WHEN {_STATE_SQL} = 'conflict' THEN 'alert' ELSE 'normal' END AS tone FROM orders"""
)
def overlays(spark, sf_dir):
    """A page's readout."""
    o = shown.overlay(F.col("p"), F.col("m"), F.col("c"), F.col("all"), now())
    return _shown_pages(spark, sf_dir).select("page_id", *(o[f].alias(f) for f in ("muted", "detail", "conflict", "tone")))


@query("SELECT policy, count(*) AS urls FROM (SELECT o_orderkey % 4 AS k FROM orders), (VALUES ('off'), ('literal'), ('strict')) p(policy) WHERE CASE policy WHEN 'off' THEN k <> 3 WHEN 'literal' THEN k IN (0, 1) ELSE k = 0 END GROUP BY policy")
def fetch_policies(spark, sf_dir):
    """Public hosts, hosts that resolve to private addresses, private addresses and other schemes, under each policy."""
    forms = F.array(*map(F.lit, ("https://a.example/", "https://b.example/", "http://10.0.0.1/", "ftp://a.example/")))
    urls = table(spark, sf_dir, "orders").select(F.concat(F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_orderkey").cast("string")).alias("url"))
    dns = spark.createDataFrame([("a.example", "8.8.8.8"), ("b.example", "8.8.4.4"), ("b.example", "10.0.0.9")], "host string, address string")
    out = None
    for policy in ("off", "literal", "strict"):
        row = may_fetch(urls, policy, dns).agg(F.count("*").alias("urls")).select(F.lit(policy).alias("policy"), "urls")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderpriority AS list, CASE WHEN count(*) FILTER (WHERE o_orderpriority < '3' AND o_orderkey % 3 > 0) > 0 THEN 0 ELSE 1 END AS status FROM orders GROUP BY o_orderpriority")
def exit_statuses(spark, sf_dir):
    """What a run over each list of pages ends with: 0 if it has found a date."""
    dated = (F.col("o_orderpriority") < "3") & (F.col("o_orderkey") % 3 > 0)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("list"), F.when(dated, day("o_orderdate")).alias("published"), F.lit(None).cast("string").alias("modified"), F.when(~dated, "unreachable").alias("error"))
    return rows.groupBy("list").agg(batch.exit_status(rows).alias("status"))


@query("SELECT user_id % 5 AS cleared, count(*) AS entries FROM (SELECT user_id FROM events), (SELECT unnest(range(5)) AS c) WHERE user_id % 5 <> c GROUP BY ALL")
def cache_without_hosts(spark, sf_dir):
    """Five caches, each cleared of one host: what is left of the others."""
    cache = table(spark, sf_dir, "events").select(F.concat(F.lit("https://h"), F.col("user_id") % 5, F.lit(".example/"), F.col("event_id")).alias("url"), (F.col("user_id") % 5).alias("cleared"))
    out = None
    for k in range(5):
        left = batch.clear_cache(cache, f"h{k}.example")
        out = left if out is None else out.unionByName(left)
    return out.groupBy("cleared").agg(F.count("*").alias("entries"))


@query("SELECT count(*) AS entries, sum(length('{\"url\":\"' || event_id || '\",\"result\":\"' || event_type || '\"}'))::BIGINT AS chars FROM events")
def cache_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("url"), F.col("event_type").alias("result"))
    return batch.cache_stats(rows)


_ENGINE_HOSTS = ["www.google.co.uk", "google.evil.example", "BING.com", "www.bing.com", "notbing.com", "duckduckgo.com", "news.ycombinator.com", "old.reddit.com", "reddit.com", "google.com."]
_ENGINE_SQL = "CASE WHEN host ~ '(^|\\.)google(\\.[a-z]{2,4}){1,2}$' THEN 'google' WHEN host ~ '(^|\\.)bing\\.com$' THEN 'bing' WHEN host ~ '(^|\\.)duckduckgo\\.com$' THEN 'duckduckgo' WHEN host ~ '(^|\\.)news\\.ycombinator\\.com$' THEN 'hackernews' WHEN host ~ '(^|\\.)old\\.reddit\\.com$' THEN 'reddit' END"


@query(f"SELECT o_orderkey AS page_id, {_ENGINE_SQL} AS engine FROM (SELECT o_orderkey, rtrim(lower(h), '.') AS host FROM orders JOIN (VALUES " + ", ".join(f"({k}, '{h}')" for k, h in enumerate(_ENGINE_HOSTS)) + f") t(k, h) ON k = o_orderkey % {len(_ENGINE_HOSTS)})")
def search_engines(spark, sf_dir):
    """The search engine that each results page is of."""
    host = F.element_at(F.array(*map(F.lit, _ENGINE_HOSTS)), (F.col("o_orderkey") % len(_ENGINE_HOSTS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), search_engine(host).alias("engine"))


_LABELS_SQL = {"jsonld": "JSON-LD", "jsonld-container": "JSON-LD (page node)", "opengraph": "Open Graph", "url-slug": "URL", "http-last-modified": "Last-Modified header", "meta-date": "meta date", "time-tag": "time tag", "rss-feed": "rss feed", "itemprop": "itemprop", "my_own-source": "my own source"}


@query("SELECT l_orderkey AS page_id, l_linenumber AS ord, label FROM lineitem JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(_LABELS_SQL.values())) + f") t(k, label) ON k = (l_orderkey + l_linenumber) % {len(_LABELS_SQL)}")
def source_labels(spark, sf_dir):
    """What the sources of each page's candidates are called."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % len(_LABELS_SQL)
    source = F.element_at(F.array(*map(F.lit, _LABELS_SQL)), (k + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ord"), source_label(source).alias("label"))


@query("SELECT o_custkey AS results_url, count(*) AS links FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey")
def result_links(spark, sf_dir):
    """Links of results pages that lead to other hosts."""
    k = F.col("o_orderkey") % 3
    url = F.when(k == 0, "HTTPS://other.example/").when(k == 1, "https://www.google.com/x").otherwise("mailto:x@other.example")
    links = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://www.google.com/search?q="), "o_custkey").alias("results_url"), F.col("o_orderkey").alias("ord"), url.alias("url"), "o_custkey")
    return result_hosts(links).groupBy(F.col("o_custkey").alias("results_url")).agg(F.count("*").alias("links"))
