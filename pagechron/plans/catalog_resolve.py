"""Queries of resolution, conflicts and verdicts, over candidates made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts
from ..types import CANDIDATE, candidate
from .registry import NOW, day, now, query, table
from .resolve import archive_lookup, collect_candidates, resolve


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")


def _list(*items):
    """An array of candidates, nulls left out."""
    return F.filter(F.array(*items).cast(f"array<{CANDIDATE}>"), lambda c: c["value"].isNotNull())


def _ships(spark, sf_dir, source, confidence, field):
    """Orders with their items' ship dates as candidates, in order of line number."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    rows = rows.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq"), candidate(day("l_shipdate"), "day", field, source, confidence, None).alias("c")).select("o_orderkey", "seq", "c.*")
    return _orders(spark, sf_dir).join(collect_candidates(rows, ["o_orderkey"], ["seq"]), "o_orderkey", "left")


_RANKED = """SELECT l_orderkey AS o_orderkey, arg_max(source, struct_pack(r := r, s := -l_linenumber)) AS source, arg_max(strftime(l_shipdate, '%Y-%m-%d'), struct_pack(r := r, s := -l_linenumber, d := -epoch(l_shipdate))) AS value
FROM (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 'time-tag' WHEN 1 THEN 'dublin-core' WHEN 2 THEN 'jsonld' WHEN 3 THEN 'visible-text' ELSE 'my-source' END AS source,
  CASE l_linenumber % 5 WHEN 0 THEN 20453 WHEN 1 THEN 20603 WHEN 2 THEN 20903 WHEN 3 THEN 10153 ELSE 20303 END AS r FROM lineitem) GROUP BY l_orderkey"""


@query(_RANKED)
def rank_best(spark, sf_dir):
    """The best candidate of each page: tier, then source, then precision, then order."""
    k = F.col("l_linenumber") % 5
    source = F.when(k == 0, "time-tag").when(k == 1, "dublin-core").when(k == 2, "jsonld").when(k == 3, "visible-text").otherwise("my-source")
    tier = F.when(k == 3, "inferred").otherwise("derived")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq"), candidate(day("l_shipdate"), "day", "published", source, tier, None).alias("c")).select("o_orderkey", "seq", "c.*")
    out = resolve(collect_candidates(rows, ["o_orderkey"], ["seq"]), now())
    return out.select("o_orderkey", F.col("published.source").alias("source"), F.col("published.value").alias("value"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate::DATE + CASE WHEN k BETWEEN 15 AND 44 THEN k ELSE 45 END, '%Y-%m-%d') AS value, CASE WHEN k BETWEEN 15 AND 44 THEN 'opengraph' ELSE 'jsonld' END AS source,
  CASE WHEN abs(45 - k) > 30 THEN 'declared-disagreement' END AS conflict, CASE WHEN abs(45 - k) > 30 THEN abs(45 - k) END AS gap_days
  FROM (SELECT o_orderkey, o_orderdate, (o_orderkey % 80)::INT AS k FROM orders)"""
)
def earliest_declared(spark, sf_dir):
    k = (F.col("o_orderkey") % 80).cast("int")
    at = lambda n: day(F.date_add(F.col("o_orderdate").cast("date"), n))
    cands = _list(candidate(at(F.lit(45)), "day", "published", "jsonld", "declared", "a"), candidate(at(k), "day", "published", "opengraph", "declared", "b"))
    out = resolve(_orders(spark, sf_dir).withColumn("candidates", cands), now())
    return out.select("o_orderkey", F.col("published.value").alias("value"), F.col("published.source").alias("source"), F.col("conflict.kind").alias("conflict"), F.col("conflict.gap_days").alias("gap_days"))


@query(
    """SELECT o_orderkey, CASE WHEN k = 0 OR k = 1 THEN 'time-tag' WHEN k = 2 THEN 'url-slug' WHEN k = 3 THEN 'jsonld' END AS source, CASE WHEN k IN (0, 1) THEN true WHEN k IN (2, 3) THEN false END AS promoted
  FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)"""
)
def promote_unknown(spark, sf_dir):
    """An unlabelled date read as published: where nothing is, or over a weaker one, never after the update."""
    k, d = F.col("o_orderkey") % 5, day("o_orderdate")
    later = day(F.date_add(F.col("o_orderdate").cast("date"), 10))
    unknown = candidate(F.when(k == 2, day("o_orderdate", "yyyy-MM")).when(k == 4, later).otherwise(d), F.when(k == 2, "month").otherwise("day"), "unknown", "time-tag", "derived", None)
    weak = candidate(F.when(k.isin(1, 2), d), "day", "published", "url-slug", "inferred", None)
    strong = candidate(F.when(k == 3, d), "day", "published", "jsonld", "declared", None)
    update = candidate(F.when(k == 4, d), "day", "modified", "sitemap", "derived", None)
    out = resolve(_orders(spark, sf_dir).withColumn("candidates", _list(unknown, weak, strong, update)), now())
    return out.select("o_orderkey", F.col("published.source").alias("source"), F.contains("published.note", F.lit("read as published")).alias("_n"), "published").select("o_orderkey", "source", F.when(F.col("published").isNotNull(), F.coalesce("_n", F.lit(False))).alias("promoted"))


_LOCAL = """(SELECT event_id, date_trunc('minute', ts) AS u, CASE event_id % 4 WHEN 0 THEN -480 WHEN 1 THEN -300 WHEN 2 THEN 330 ELSE 540 END AS o FROM events)"""


@query(
    f"""SELECT event_id, CASE WHEN (u + to_minutes(o))::DATE <> u::DATE THEN strftime(u + to_minutes(o), '%Y-%m-%dT%H:%M') || CASE o WHEN -480 THEN '-08:00' WHEN -300 THEN '-05:00' WHEN 330 THEN '+05:30' ELSE '+09:00' END
  ELSE strftime(u, '%Y-%m-%dT%H:%M') || 'Z' END AS value FROM {_LOCAL}"""
)
def localise_offset(spark, sf_dir):
    """A UTC timestamp shown in the zone that another, naive one tells."""
    o = F.element_at(F.array(F.lit(-480), F.lit(-300), F.lit(330), F.lit(540)), (F.col("event_id") % 4 + 1).cast("int"))
    u = F.date_trunc("minute", "ts")
    local = day(F.timestamp_millis(F.unix_millis(u) + o * 60_000), "yyyy-MM-dd'T'HH:mm")
    cands = _list(candidate(F.concat(day(u, "yyyy-MM-dd'T'HH:mm"), F.lit("Z")), "minute", "published", "jsonld", "declared", None), candidate(local, "minute", "unknown", "time-tag", "derived", None))
    out = resolve(table(spark, sf_dir, "events").select("event_id", "ts").withColumn("candidates", cands), F.lit("2026-01-01").cast("timestamp"))
    return out.select("event_id", F.col("published.value").alias("value"))


@query(
    f"""SELECT event_id, CASE WHEN (u + to_minutes(o))::DATE <> u::DATE THEN strftime(u + to_minutes(o), '%Y-%m-%d') ELSE strftime(u, '%Y-%m-%dT%H:%M') || 'Z' END AS value,
  CASE WHEN (u + to_minutes(o))::DATE <> u::DATE THEN 'day' ELSE 'minute' END AS precision FROM {_LOCAL}"""
)
def localise_day(spark, sf_dir):
    """The day a page states where its UTC timestamp lies just across midnight."""
    o = F.element_at(F.array(F.lit(-480), F.lit(-300), F.lit(330), F.lit(540)), (F.col("event_id") % 4 + 1).cast("int"))
    u = F.date_trunc("minute", "ts")
    cands = _list(candidate(F.concat(day(u, "yyyy-MM-dd'T'HH:mm"), F.lit("Z")), "minute", "published", "jsonld", "declared", None), candidate(day(F.timestamp_millis(F.unix_millis(u) + o * 60_000)), "day", "published", "visible-text", "inferred", None))
    out = resolve(table(spark, sf_dir, "events").select("event_id", "ts").withColumn("candidates", cands), F.lit("2026-01-01").cast("timestamp"))
    return out.select("event_id", F.col("published.value").alias("value"), F.col("published.precision").alias("precision"))


@query(
    """SELECT l_orderkey AS o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS earlier, strftime(max(l_shipdate), '%Y-%m-%d') AS later, date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) AS gap_days
  FROM lineitem GROUP BY l_orderkey HAVING date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) > 30"""
)
def conflict_disagreement(spark, sf_dir):
    out = resolve(_ships(spark, sf_dir, "jsonld", "declared", "published"), now()).filter("conflict.kind = 'declared-disagreement'")
    return out.select("o_orderkey", F.col("conflict.earlier.value").alias("earlier"), F.col("conflict.later.value").alias("later"), F.col("conflict.gap_days").alias("gap_days"))


@query(
    """SELECT o_orderkey, strftime(p, '%Y-%m-%d') AS declared, count(DISTINCT l_shipdate::DATE) AS older_count, strftime(min(l_shipdate), '%Y-%m-%d') AS oldest, date_diff('day', min(l_shipdate)::DATE, p) AS gap_days
  FROM (SELECT o_orderkey, o_orderdate::DATE + 500 AS p FROM orders) JOIN lineitem ON l_orderkey = o_orderkey WHERE date_diff('day', l_shipdate::DATE, p) > 365 GROUP BY o_orderkey, p HAVING count(DISTINCT l_shipdate::DATE) >= 3"""
)
def conflict_predated(spark, sf_dir):
    declared = candidate(day(F.date_add(F.col("o_orderdate").cast("date"), 500)), "day", "published", "jsonld", "declared", None)
    pages = _ships(spark, sf_dir, "time-tag", "derived", "unknown")
    pages = pages.withColumn("candidates", F.concat(_list(declared), F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>"))))
    out = resolve(pages, F.lit("2010-01-01").cast("timestamp")).filter("conflict.kind = 'predated-content'").select("o_orderkey", "conflict.*")
    return out.select("o_orderkey", "declared", F.col("older_count").cast("bigint").alias("older_count"), "oldest", "gap_days")


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS declared, strftime(o_orderdate::DATE + k, '%Y-%m-%d') AS archived, k AS gap_days FROM (SELECT *, (o_orderkey % 800)::INT AS k FROM orders) WHERE k > 365 AND o_orderkey % 3 <> 0"""
)
def conflict_stale(spark, sf_dir):
    d = day("o_orderdate")
    cands = _list(candidate(d, "day", "published", "jsonld", "declared", None), candidate(F.when(F.col("o_orderkey") % 3 == 0, d), "day", "modified", "sitemap", "derived", None))
    edit = day(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 800).cast("int")))
    out = resolve(_orders(spark, sf_dir).withColumn("candidates", cands), F.lit("2010-01-01").cast("timestamp"), edit).filter("conflict.kind = 'stale-declaration'")
    return out.select("o_orderkey", F.col("conflict.declared").alias("declared"), F.col("conflict.archived").alias("archived"), F.col("conflict.gap_days").alias("gap_days"))


_SPANS = f"""(SELECT o_orderkey, s, CASE k WHEN 0 THEN s + INTERVAL 1 DAY WHEN 1 THEN s + INTERVAL 1 MONTH ELSE s + INTERVAL 1 YEAR END AS e, k, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(s)) / 86400000.0 AS most
  FROM (SELECT o_orderkey, o_orderkey % 3 AS k, date_trunc(CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END, o_orderdate)::TIMESTAMP AS s FROM orders))"""
_VERDICT = f"""(SELECT o_orderkey, floor(least)::BIGINT AS age_days, floor(most)::BIGINT AS max_age_days, CASE WHEN most <= 1000 THEN 'fresh' WHEN least > 1000 THEN 'stale' ELSE 'imprecise' END AS reason
  FROM (SELECT *, (epoch_ms(TIMESTAMP '{NOW}') - (epoch_ms(e) - 1)) / 86400000.0 AS least FROM {_SPANS}))"""


def _aged(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    value = F.when(k == 0, day("o_orderdate")).when(k == 1, day("o_orderdate", "yyyy-MM")).otherwise(day("o_orderdate", "yyyy"))
    precision = F.when(k == 0, "day").when(k == 1, "month").otherwise("year")
    pages = _orders(spark, sf_dir).withColumn("published", candidate(value, precision, "published", "jsonld", "declared", None))
    return pages.withColumn("v", verdicts.staleness(F.col("published"), F.lit(None).cast(CANDIDATE), 1000, now()))


@query(f"SELECT o_orderkey, reason, CASE reason WHEN 'fresh' THEN false WHEN 'stale' THEN true END AS stale, age_days, max_age_days, 'published' AS basis FROM {_VERDICT}")
def staleness_verdict(spark, sf_dir):
    return _aged(spark, sf_dir).select("o_orderkey", "v.reason", "v.stale", "v.age_days", "v.max_age_days", "v.basis")


@query(f"SELECT count(*) FILTER (WHERE reason <> 'fresh') AS stale_or_unknown, count(*) FILTER (WHERE reason = 'stale') AS surely_stale FROM {_VERDICT}")
def is_stale_filter(spark, sf_dir):
    rows = _aged(spark, sf_dir)
    return rows.agg(F.count_if(verdicts.is_stale(F.col("v"))).alias("stale_or_unknown"), F.count_if(verdicts.is_stale(F.col("v"), False)).alias("surely_stale"))


@query(
    f"""SELECT CASE reason WHEN 'fresh' THEN 'FRESH' WHEN 'stale' THEN 'STALE' ELSE 'UNDETERMINED' END AS word, count(*) AS n FROM {_VERDICT} GROUP BY word"""
)
def freshness_words(spark, sf_dir):
    head = verdicts.freshness_headline(F.col("v"), 1000)
    return _aged(spark, sf_dir).groupBy(F.substring_index(head, " ", 1).alias("word")).agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey AS o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) AS span_days,
  count(DISTINCT l_shipdate::DATE) AS total, CASE WHEN s >= 365 THEN y || CASE WHEN y = 1 THEN ' year' ELSE ' years' END WHEN s >= 45 THEN m || CASE WHEN m = 1 THEN ' month' ELSE ' months' END ELSE s || CASE WHEN s = 1 THEN ' day' ELSE ' days' END END AS span_label
  FROM (SELECT l_orderkey, l_shipdate, s, floor(s / 365.25 + 0.5)::BIGINT AS y, floor(s / 30.44 + 0.5)::BIGINT AS m FROM (SELECT l_orderkey, l_shipdate, date_diff('day', min(l_shipdate::DATE) OVER (PARTITION BY l_orderkey), max(l_shipdate::DATE) OVER (PARTITION BY l_orderkey)) AS s FROM lineitem))
  WHERE s > 0 GROUP BY l_orderkey, s, y, m"""
)
def spread_axis(spark, sf_dir):
    """Distinct days on an axis, with its ends and its length in words."""
    pages = resolve(_ships(spark, sf_dir, "time-tag", "derived", "unknown"), now())
    rows = pages.select("o_orderkey", verdicts.spread(F.col("published"), F.col("modified"), F.col("candidates")).alias("s")).filter("s IS NOT NULL")
    return rows.select("o_orderkey", F.col("s.from").alias("first_day"), F.col("s.to").alias("last_day"), "s.span_days", F.col("s.total").cast("bigint").alias("total"), "s.span_label")


@query(
    """SELECT o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS oldest FROM (SELECT o_orderkey, o_orderdate::DATE + 500 AS p FROM orders) JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, p HAVING count(DISTINCT l_shipdate::DATE) FILTER (WHERE date_diff('day', l_shipdate::DATE, p) > 365) >= 3"""
)
def counter_evidence(spark, sf_dir):
    declared = candidate(day(F.date_add(F.col("o_orderdate").cast("date"), 500)), "day", "published", "jsonld", "declared", None)
    pages = _ships(spark, sf_dir, "time-tag", "derived", "unknown")
    pages = pages.withColumn("candidates", F.concat(_list(declared), F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>"))))
    out = resolve(pages, F.lit("2010-01-01").cast("timestamp"))
    found = verdicts.oldest_counter_evidence(F.col("published"), F.col("modified"), F.col("conflict"), F.col("candidates"))
    return out.select("o_orderkey", found["value"].alias("oldest")).filter("oldest IS NOT NULL")


@query("SELECT o_orderkey, 'Page: u' || chr(10) || 'Published: ' || strftime(o_orderdate, '%Y-%m-%d') || ' (declared by the site in machine-readable metadata; source: jsonld)' || chr(10) || 'Last modified: not stated.' AS text FROM orders")
def page_prose(spark, sf_dir):
    p = candidate(day("o_orderdate"), "day", "published", "jsonld", "declared", None)
    from ..types import CONFLICT

    return _orders(spark, sf_dir).select("o_orderkey", verdicts.page_text(F.lit("u"), p, F.lit(None).cast(CANDIDATE), F.lit(None).cast(CONFLICT)).alias("text"))


@query(
    """SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_capture, CASE WHEN count(*) > 1 THEN strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') END AS last_edit, count(*) AS changes
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY s) AS was FROM (SELECT user_id, event_type, ts, strftime(ts, '%Y%m%d%H%M%S') || event_id AS s FROM events)) WHERE was IS NULL OR was <> event_type GROUP BY user_id"""
)
def archive_last_edit(spark, sf_dir):
    """Captures to the last one whose content differs from the one before."""
    events = table(spark, sf_dir, "events").withColumn("stamp", F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.col("event_id").cast("string"))).withColumn("stamp14", F.substring("stamp", 1, 14))
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("stamp")
    changed = events.withColumn("was", F.lag("event_type").over(order)).filter("was IS NULL OR was <> event_type")
    return archive_lookup(changed.withColumn("n", F.row_number().over(order)), "user_id", "stamp14", "n", 1_000_000_000).select("user_id", "first_capture", "last_edit", "changes")
