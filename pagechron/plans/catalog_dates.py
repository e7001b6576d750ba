"""Queries of the date grammar, URLs and scalar verdicts, over dates rendered from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls, verdicts
from ..functions.dates import detect_day_first, implausible_reason, parse_date, to_instant_ms, to_interval_ms
from ..functions.guard import follow_redirects, is_safe_fetch_target
from ..functions.text import ascii_digits, fold
from ..operators.evaluate import appears_in, capture_lag_days, detect_lang, label_precedes_capture, lag_bucket, neutralise_declared, permalink_label, renderings, verify_snapshot
from .pipeline import link_state
from .registry import NOW, day, now, query, spread, table

D = "strftime(o_orderdate, '%Y-%m-%d')"
# Month names to render dates with, by language.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")


def _parsed(df, key, raw, hint="unknown"):
    df = df.withColumn("p", parse_date(raw, hint))
    return df.select(key, F.col("p.value").alias("value"), F.col("p.precision").alias("precision"))


@query(f"SELECT o_orderkey, {D} AS value, 'day' AS precision FROM orders")
def url_slug_resolve(spark, sf_dir):
    """Dates in URL paths, back from /YYYY/MM/DD/."""
    url = F.concat(F.lit("https://h.example/"), day("o_orderdate", "yyyy/MM/dd"), F.lit("/p"), F.col("o_orderkey"))
    df = _orders(spark, sf_dir).withColumn("s", urls.url_slug(url))
    return df.select("o_orderkey", F.col("s.value").alias("value"), F.col("s.precision").alias("precision"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS value, 'month' AS precision FROM orders")
def url_slug_month(spark, sf_dir):
    url = F.concat(F.lit("https://h.example/blog/"), day("o_orderdate", "yyyy/MM"), F.lit("/post-"), F.col("o_orderkey"), F.lit("?q=1999/01/01"))
    df = _orders(spark, sf_dir).withColumn("s", urls.url_slug(url))
    return df.select("o_orderkey", F.col("s.value").alias("value"), F.col("s.precision").alias("precision"))


@query(f"SELECT o_orderkey, {D} AS value FROM orders")
def url_slug_named_month(spark, sf_dir):
    name = F.element_at(F.split(F.lit(MONTHS["it"]), " "), F.month("o_orderdate"))
    url = F.concat(F.lit("https://h.example/"), F.year("o_orderdate"), F.lit("/"), name, F.lit("/"), F.dayofmonth("o_orderdate"), F.lit("/x"))
    return _orders(spark, sf_dir).select("o_orderkey", urls.url_slug(url)["value"].alias("value"))


@query(f"SELECT o_orderkey, {D} AS value FROM orders")
def image_path(spark, sf_dir):
    url = F.concat(F.lit("https://cdn.example/up/"), day("o_orderdate", "yyyy/MM/dd"), F.lit("/i.jpg"))
    return _orders(spark, sf_dir).select("o_orderkey", urls.image_path_day(url).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') || '+02:00' AS value, 'minute' AS precision, epoch_ms(date_trunc('minute', ts)) - 7200000 AS at_ms FROM events")
def parse_iso(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("p", parse_date(day("ts", "yyyy-MM-dd'T'HH:mm:ss'+0200'")))
    return df.select("event_id", F.col("p.value").alias("value"), F.col("p.precision").alias("precision"), to_instant_ms(F.col("p.value")).alias("at_ms"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') || 'Z' AS value, 'minute' AS precision FROM events")
def parse_rfc2822(spark, sf_dir):
    return _parsed(table(spark, sf_dir, "events"), "event_id", F.concat(day("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))


@query(f"SELECT o_orderkey, {D} AS value, 'day' AS precision FROM orders")
def parse_year_first(spark, sf_dir):
    return _parsed(_orders(spark, sf_dir), "o_orderkey", day("o_orderdate", "yyyy.M.d"))


@query(f"SELECT o_orderkey, {D} AS value, 'day' AS precision FROM orders")
def parse_cjk(spark, sf_dir):
    return _parsed(_orders(spark, sf_dir), "o_orderkey", day("o_orderdate", "yyyy'年'M'月'd'日'"))


@query(f"SELECT o_orderkey, {D} AS value, 'day' AS precision FROM orders")
def parse_numeric_hint(spark, sf_dir):
    df = _orders(spark, sf_dir)
    odd = F.col("o_orderkey") % 2 == 1
    raw = F.when(odd, day("o_orderdate", "d/M/yyyy")).otherwise(day("o_orderdate", "MM-dd-yyyy"))
    return _parsed(df, "o_orderkey", raw, F.when(odd, "day-first").otherwise("month-first"))


@query(f"SELECT o_orderkey, CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN {D} ELSE strftime(o_orderdate, '%Y') END AS value, CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN 'day' ELSE 'year' END AS precision FROM orders")
def parse_numeric_ambiguous(spark, sf_dir):
    return _parsed(_orders(spark, sf_dir), "o_orderkey", day("o_orderdate", "dd.MM.yyyy"))


@query(f"SELECT o_orderkey, {D} AS value, 'day' AS precision FROM orders")
def parse_textual(spark, sf_dir):
    """Dates written in six languages, the day first."""
    names = F.split(F.element_at(F.array(*(F.lit(v) for v in MONTHS.values())), (F.col("o_orderkey") % 6 + 1).cast("int")), " ")
    raw = F.concat(F.dayofmonth("o_orderdate"), F.when(F.col("o_orderkey") % 6 == 3, ". ").when(F.col("o_orderkey") % 6 == 4, " de ").otherwise(" "), F.element_at(names, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate"))
    return _parsed(_orders(spark, sf_dir), "o_orderkey", raw)


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {D} ELSE strftime(o_orderdate, '%Y-%m') END AS value FROM orders")
def parse_month_first(spark, sf_dir):
    """'March 3rd, 1999' and 'March 1999'."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(day("o_orderdate", "MMMM d"), F.lit("th, "), F.year("o_orderdate"))).otherwise(day("o_orderdate", "MMMM yyyy"))
    return _parsed(_orders(spark, sf_dir), "o_orderkey", raw).drop("precision")


@query(f"SELECT o_orderkey, {D} AS ascii, {D} AS value FROM orders")
def normalise_digits(spark, sf_dir):
    base = F.element_at(F.array(*(F.lit("".join(chr(b + k) for k in range(10))) for b in (0x0660, 0x06F0, 0x0966, 0x0E50, 0xFF10))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    digits = F.transform(F.split(day("o_orderdate"), ""), lambda c: F.when(c.rlike("[0-9]"), F.substr(base, c.try_cast("int") + 1, F.lit(1))).otherwise(c))
    raw = F.array_join(digits, "")
    return _orders(spark, sf_dir).select("o_orderkey", ascii_digits(raw).alias("ascii"), parse_date(raw)["value"].alias("value"))


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def fold_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("folded"))


@query(
    """SELECT page_id, CASE WHEN l NOT IN ('', 'en') THEN 'day-first' ELSE 'unknown' END AS hint, l AS lang, h AS host FROM (
  SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS l, regexp_extract(url, '^https?://([^/]*)', 1) AS h FROM pages)"""
)
def detect_hint(spark, sf_dir):
    """Which number comes first on each page."""
    host, lang = urls.host_of(F.col("url")), detect_lang(F.col("html"), F.lit("com"))
    return table(spark, sf_dir, "pages").select("page_id", detect_day_first(lang, host).alias("hint"), lang.alias("lang"), host.alias("host"))


@query(
    f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ts > TIMESTAMP '2024-01-15' + INTERVAL 48 HOUR THEN 'in the future'
  WHEN abs(epoch_ms(date_trunc('minute', ts)) - epoch_ms(TIMESTAMP '2024-01-15')) < 60000 THEN 'looks like a render timestamp' ELSE 'ok' END AS reason
  FROM (SELECT date_trunc('minute', ts) AS ts FROM events)
  UNION ALL SELECT CASE WHEN year(o_orderdate) - 3 < 1995 THEN 'before 1995' ELSE 'ok' END FROM orders) GROUP BY reason"""
)
def plausibility_reasons(spark, sf_dir):
    at = F.unix_millis(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    a = table(spark, sf_dir, "events").select(implausible_reason(F.concat(day("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("Z")), F.lit("minute"), at).alias("reason"))
    early = F.concat_ws("-", (F.year("o_orderdate") - 3).cast("string"), day("o_orderdate", "MM"))
    b = _orders(spark, sf_dir).select(implausible_reason(early, F.lit("month"), at).alias("reason"))
    return a.union(b).select(F.coalesce("reason", F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, epoch_ms(s) AS start_ms, epoch_ms(CASE o_orderkey % 3 WHEN 0 THEN s + INTERVAL 1 DAY WHEN 1 THEN s + INTERVAL 1 MONTH ELSE s + INTERVAL 1 YEAR END) AS end_ms
  FROM (SELECT o_orderkey, date_trunc(CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END, o_orderdate)::TIMESTAMP AS s FROM orders)"""
)
def to_interval(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    value = F.when(k == 0, day("o_orderdate")).when(k == 1, day("o_orderdate", "yyyy-MM")).otherwise(day("o_orderdate", "yyyy"))
    precision = F.when(k == 0, "day").when(k == 1, "month").otherwise("year")
    df = _orders(spark, sf_dir).withColumn("i", to_interval_ms(value, precision))
    return df.select("o_orderkey", F.col("i.start_ms").alias("start_ms"), F.col("i.end_ms").alias("end_ms"))


_DAYS = f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate::DATE::TIMESTAMP)) / 86400000.0"


@query(
    f"""SELECT o_orderkey, CASE WHEN d < -1 THEN '→' WHEN d < 30 THEN greatest(1, floor(d + 0.5))::BIGINT || 'd' WHEN d < 365 THEN floor(d / 30.44 + 0.5)::BIGINT || 'mo' ELSE floor(d / 365.25 + 0.5)::BIGINT || 'y' END AS age
  FROM (SELECT o_orderkey, {_DAYS} AS d FROM orders)"""
)
def compact_age(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", verdicts.compact_age(day("o_orderdate"), now()).alias("age"))


@query(
    f"""SELECT o_orderkey, CASE WHEN d < 1 THEN 'today' WHEN d < 45 THEN CASE WHEN n = 1 THEN 'yesterday' ELSE n || ' days ago' END
    WHEN d < 550 THEN CASE WHEN m = 1 THEN 'last month' ELSE m || ' months ago' END ELSE CASE WHEN y = 1 THEN 'last year' ELSE y || ' years ago' END END AS age
  FROM (SELECT *, floor(d + 0.5)::BIGINT AS n, floor(d / 30.44 + 0.5)::BIGINT AS m, floor(d / 365.25 + 0.5)::BIGINT AS y FROM (SELECT o_orderkey, {_DAYS} AS d FROM orders))"""
)
def relative_age(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", verdicts.relative_age(day("o_orderdate"), F.lit("day"), now()).alias("age"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS day_text, strftime(o_orderdate, '%B %Y') AS month_text FROM orders")
def display_dates(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", verdicts.display(day("o_orderdate"), F.lit("day")).alias("day_text"), verdicts.display(day("o_orderdate", "yyyy-MM"), F.lit("month")).alias("month_text"))


@query("SELECT h AS host, CASE WHEN ('0x' || substr(sha1(h), 1, 2))::INT % 3 = 0 THEN 'test' ELSE 'dev' END AS split, count(*) AS pages FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS h FROM pages) GROUP BY h")
def host_split(spark, sf_dir):
    host = urls.host_of(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.first(urls.split_of(host)).alias("split"), F.count("*").alias("pages"))


@query("SELECT page_id, substr(sha1(url), 1, 16) AS id, 'https://web.archive.org/web/20240101000000id_/' || url AS archived FROM pages")
def entry_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.entry_id(F.col("url")).alias("id"), urls.archive_url(F.lit("20240101000000"), F.col("url")).alias("archived"))


@query("SELECT page_id, split_part(url, '#', 1) = split_part(regexp_replace(url, '#top$', ''), '#', 1) AS same, lower(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')) AS path FROM pages")
def page_paths(spark, sf_dir):
    bare = F.regexp_replace("url", "#top$", "")
    return table(spark, sf_dir, "pages").select("page_id", urls.same_document(F.col("url"), bare).alias("same"), urls.normal_path(urls.path_of(F.col("url"))).alias("path"))


@query("SELECT page_id, url AS target FROM pages")
def redirect_targets(spark, sf_dir):
    """Links unwrapped from redirectors, their own queries and fragments kept."""
    df = table(spark, sf_dir, "pages")
    name = F.element_at(F.array(*(F.lit(k) for k in ("url", "uddg", "u", "q"))), (F.col("page_id") % 4 + 1).cast("int"))
    wrapped = F.concat(F.lit("https://r.example/l?x=1&"), name, F.lit("="), F.url_encode("url"), F.lit("&y=2"))
    return df.select("page_id", urls.target_of(wrapped).alias("target"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://h.example/x/yr/mo/dy/p' WHEN 1 THEN 'https://h.example/x/yr-mo-dy-p'
  ELSE 'https://h.example/x/' || strftime(o_orderdate, '%Y/%m') || '/p' END || o_orderkey || '?d=' || strftime(o_orderdate, '%Y-%m-%d') AS url FROM orders"""
)
def neutralise_urls(spark, sf_dir):
    """Whole days in paths are blanked; a year and month alone, and queries, stay."""
    k = F.col("o_orderkey") % 3
    path = F.when(k == 0, F.concat(day("o_orderdate", "yyyy/M/d"), F.lit("/p"))).when(k == 1, F.concat(day("o_orderdate"), F.lit("-p"))).otherwise(F.concat(day("o_orderdate", "yyyy/MM"), F.lit("/p")))
    url = F.concat(F.lit("https://h.example/x/"), path, F.col("o_orderkey"), F.lit("?d="), day("o_orderdate"))
    return _orders(spark, sf_dir).select("o_orderkey", urls.neutralise(url).alias("url"))


@query("SELECT o_orderkey, '<link rel=\"canonical\" href=\"https://h.example/yr/mo/dy/p\"><meta property=''og:url'' content=''https://h.example/yr-mo-dy-p''><a href=\"/2001/02/03/\">x</a>' AS html FROM orders")
def neutralise_pages(spark, sf_dir):
    """Days blanked in what a page says its own address is, nowhere else."""
    html = F.concat(
        F.lit('<link rel="canonical" href="https://h.example/'), day("o_orderdate", "yyyy/MM/dd"), F.lit("/p\"><meta property='og:url' content='https://h.example/"), day("o_orderdate"),
        F.lit("-p'><a href=\"/2001/02/03/\">x</a>"),
    )
    return _orders(spark, sf_dir).select("o_orderkey", neutralise_declared(html).alias("html"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'denied' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'none' ELSE 'dated' END AS state FROM orders")
def link_states(spark, sf_dir):
    """What checking a link came to."""
    k = F.col("o_orderkey") % 4
    return _orders(spark, sf_dir).select("o_orderkey", link_state(k != 0, k != 1, F.when(k == 3, day("o_orderdate"))).alias("state"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {D} WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') END AS day FROM orders")
def tool_days(spark, sf_dir):
    """Tools' answers cut to the date that leads them."""
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, F.concat(day("o_orderdate"), F.lit("T10:00:00Z"))).when(k == 1, day("o_orderdate", "yyyy-MM")).otherwise("none found")
    return _orders(spark, sf_dir).select("o_orderkey", urls.normal_tool_day(said).alias("day"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN {D} WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-%m') END AS published,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'day' WHEN o_orderkey % 5 = 2 THEN 'month' END AS precision FROM orders"""
)
def permalink_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    path = (
        F.when(k == 0, F.concat(day("o_orderdate", "yyyy/M/d"), F.lit("/a-post")))
        .when(k == 1, F.concat(F.lit("blog/"), day("o_orderdate"), F.lit("-a-post")))
        .when(k == 2, F.concat(day("o_orderdate", "yyyy/MM"), F.lit("/a-post")))
        .when(k == 3, F.concat(day("o_orderdate", "yyyy/MM/dd"), F.lit("/feed/")))
        .otherwise(F.concat(day("o_orderdate", "yyyy/MM/dd"), F.lit("/12345")))
    )
    df = _orders(spark, sf_dir).withColumn("l", permalink_label(F.concat(F.lit("https://h.example/"), path), True, F.lit(2026)))
    return df.select("o_orderkey", F.col("l.published").alias("published"), F.col("l.precision").alias("precision"))


@query(
    """SELECT bucket, count(*) AS n, sum(ok::INT)::BIGINT AS precedes FROM (SELECT CASE WHEN d <= 1 THEN 'lag 0-1d' WHEN d <= 7 THEN 'lag 2-7d' WHEN d <= 30 THEN 'lag 8-30d' WHEN d <= 365 THEN 'lag 31-365d' ELSE 'lag >1y' END AS bucket, d >= -1 AS ok
  FROM (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 20 AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey)) GROUP BY bucket"""
)
def capture_lag_buckets(spark, sf_dir):
    df = _orders(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    label, snap = day("o_orderdate"), F.date_format(F.date_sub("l_shipdate", 20), "yyyyMMdd'120000'")
    return df.groupBy(lag_bucket(capture_lag_days(label, snap)).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(label_precedes_capture(label, snap)).cast("bigint").alias("precedes"))


@query("SELECT o_orderkey, true AS numeric_form, true AS named_form, false AS inside_number FROM orders")
def written_forms(spark, sf_dir):
    """A label's written forms, looked for in text."""
    orders = spread(_orders(spark, sf_dir)).withColumn("forms", renderings(day("o_orderdate"), F.array(day("o_orderdate", "MMMM"))))
    seen = lambda text: F.exists("forms", lambda f: appears_in(text, f))
    return orders.select(
        "o_orderkey", seen(F.concat(F.lit("on "), day("o_orderdate", "d.M.yyyy"), F.lit("!"))).alias("numeric_form"), seen(F.concat(F.lit("x "), day("o_orderdate", "d MMMM yyyy"))).alias("named_form"),
        seen(F.concat(F.lit("9"), day("o_orderdate", "yyyyMMdd"), F.lit("9"))).alias("inside_number"),
    )


@query("SELECT CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 7 = 1 THEN 'changed' ELSE 'ok' END AS state, count(*) AS n FROM pages GROUP BY state")
def verify_snapshots(spark, sf_dir):
    k = F.col("page_id") % 7
    html, said = F.when(k != 0, F.col("html")), F.when(k == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.col("html"), 256))
    return table(spark, sf_dir, "pages").groupBy(verify_snapshot(html, said).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT l AS lang, count(*) AS n FROM (SELECT CASE WHEN page_id % 3 = 0 THEN 'de' ELSE regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) END AS l FROM pages) GROUP BY l")
def page_languages(spark, sf_dir):
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<html lang=\"[a-z]*\"", "<html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").groupBy(detect_lang(html, F.lit("at")).alias("lang")).agg(F.count("*").alias("n"))


_HOSTS = ["127.0.0.1", "2130706433", "0x7f.1", "0177.0.0.1", "10.1.2.3", "169.254.169.254", "[::1]", "[fe80::1]", "[::ffff:10.0.0.1]", "localhost", "db.internal", "intranet", "8.8.8.8", "example.org", "[2606:4700::1]", "user:pw@example.org"]
_SAFE = [h in ("8.8.8.8", "example.org", "[2606:4700::1]") for h in _HOSTS]


@query("SELECT host, safe, count(*) AS n FROM (SELECT o_orderkey % 16 AS k FROM orders) JOIN (VALUES " + ", ".join(f"({k}, '{h}', {str(s).lower()})" for k, (h, s) in enumerate(zip(_HOSTS, _SAFE, strict=True))) + ") t(k, host, safe) USING (k) GROUP BY host, safe")
def safe_fetch_targets(spark, sf_dir):
    host = F.element_at(F.array(*(F.lit(h) for h in _HOSTS)), (F.col("o_orderkey") % 16 + 1).cast("int"))
    df = _orders(spark, sf_dir).select(host.alias("host"), is_safe_fetch_target(F.concat(F.lit("http://"), host, F.lit("/a"))).alias("safe"))
    return df.groupBy("host", "safe").agg(F.count("*").alias("n"))


@query("SELECT 'https://a.example/' || n_nationkey AS url, CASE WHEN n_nationkey % 5 <= 3 THEN 'https://a.example/' || n_nationkey || repeat('/x', (n_nationkey % 5)::INT) END AS final_url FROM nation")
def redirect_hops(spark, sf_dir):
    """Redirects followed three hops at most."""
    start = table(spark, sf_dir, "nation").select(F.concat(F.lit("https://a.example/"), F.col("n_nationkey").cast("string")).alias("url"), (F.col("n_nationkey") % 5).cast("int").alias("hops"))
    hops = start.filter("hops > 0").select("url", F.explode(F.sequence(F.lit(0), F.col("hops") - 1)).alias("k"))
    at = lambda k: F.concat("url", F.repeat(F.lit("/x"), k))
    return follow_redirects(start, hops.select(at(F.col("k")).alias("url"), at(F.col("k") + 1).alias("location")))
