"""Queries of batch input, caches and the evaluation suite."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..streaming import batch
from .registry import day, query, table

# What tool `a` found: right, coarser, another day, nothing; by the order's key.
_FOUND = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate::DATE + 1, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate::DATE + 90, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_VERDICT = "CASE o_orderkey % 7 WHEN 0 THEN 'missed' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' WHEN 3 THEN 'wrong' ELSE 'exact' END"
_JUDGED = f"(SELECT *, {_VERDICT} AS verdict, 'h' || (o_orderkey % 40) AS host, year(o_orderdate) AS era, substr(o_orderpriority, 1, 1) AS lang FROM orders)"
_TALLY = "count(*) AS n, count(*) FILTER (WHERE verdict = 'exact') AS exact, count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'wrong') AS wrong, count(*) FILTER (WHERE verdict = 'missed') AS missed, count(*) FILTER (WHERE verdict = 'exact') / nullif(count(*) FILTER (WHERE verdict <> 'missed'), 0)::DOUBLE AS precision, count(*) FILTER (WHERE verdict = 'exact') / count(*)::DOUBLE AS accuracy"


def _rows(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    d = F.col("o_orderdate").cast("date")
    found = F.when(k == 1, day("o_orderdate", "yyyy-MM")).when(k == 2, day(F.date_add(d, 1))).when(k == 3, day(F.date_add(d, 90))).when(k > 3, day("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("label"), found.alias("found"), F.concat(F.lit("h"), F.col("o_orderkey") % 40).alias("host"), F.year("o_orderdate").alias("era"), F.substring("o_orderpriority", 1, 1).alias("lang"))


def _judged(spark, sf_dir):
    return _rows(spark, sf_dir).withColumn("verdict", ev.judge(F.col("label"), F.col("found")))


@query(f"SELECT {_TALLY} FROM {_JUDGED}")
def judge_tally(spark, sf_dir):
    return ev.tally(_judged(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 IN (2, 4, 5, 6)) AS exact, count(*) AS n FROM orders")
def judge_tolerance(spark, sf_dir):
    verdict = ev.judge(F.col("label"), F.col("found"), 1)
    return _rows(spark, sf_dir).agg(F.count_if(verdict == "exact").alias("exact"), F.count("*").alias("n"))


@query(
    f"""SELECT 'overall' AS stratum, 'all' AS name, {_TALLY} FROM {_JUDGED} UNION ALL SELECT 'host', host, {_TALLY} FROM {_JUDGED} GROUP BY host
  UNION ALL SELECT 'era', era::VARCHAR, {_TALLY} FROM {_JUDGED} GROUP BY era UNION ALL SELECT 'lang', lang, {_TALLY} FROM {_JUDGED} GROUP BY lang"""
)
def strata_grouping_sets(spark, sf_dir):
    return ev.strata(_judged(spark, sf_dir), ["host", "era", "lang"])


@query(f"SELECT host, count(*) FILTER (WHERE verdict IN ('wrong', 'missed')) AS bad, count(*) AS n FROM {_JUDGED} GROUP BY host HAVING bad > 0 ORDER BY bad DESC, host LIMIT 15")
def worst_hosts(spark, sf_dir):
    """A top-k report: the fifteen hosts with most wrong or missed pages."""
    return ev.worst_hosts(_judged(spark, sf_dir))


@query(f"SELECT 's' || o_orderkey % 3 AS source, count(*) AS n FROM {_JUDGED} WHERE verdict = 'exact' GROUP BY o_orderkey % 3")
def winners_by_source(spark, sf_dir):
    return ev.winners(_judged(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.col("o_orderkey") % 3)))


@query(
    f"""SELECT lang, exact / nullif(exact + wrong + partial, 0)::DOUBLE AS strict_precision, exact / nullif(exact + missed, 0)::DOUBLE AS strict_recall, exact / n::DOUBLE AS strict_accuracy,
  (exact + partial) / nullif(exact + wrong + partial, 0)::DOUBLE AS lenient_precision, (exact + partial) / nullif(exact + partial + missed, 0)::DOUBLE AS lenient_recall, (exact + partial) / n::DOUBLE AS lenient_accuracy
  FROM (SELECT lang, {_TALLY} FROM {_JUDGED} GROUP BY lang)"""
)
def strict_lenient(spark, sf_dir):
    return ev.strict_lenient(_judged(spark, sf_dir), "lang").drop("strict_f1", "lenient_f1")


@query(
    f"""SELECT era, count(*) FILTER (WHERE o = 'tp') AS tp, count(*) FILTER (WHERE o = 'fp') AS fp, count(*) FILTER (WHERE o = 'fn') AS fn, count(*) FILTER (WHERE o = 'tn') AS tn, (count(*) FILTER (WHERE o IN ('tp', 'tn'))) / count(*)::DOUBLE AS accuracy
  FROM (SELECT year(o_orderdate) AS era, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'tn' ELSE 'fp' END WHEN o_orderkey % 7 = 0 THEN 'fn' WHEN o_orderkey % 7 > 3 THEN 'tp' ELSE 'fp' END AS o FROM orders) GROUP BY era"""
)
def outcome_metrics(spark, sf_dir):
    """Counts with true negatives: pages that have no date, of which none was found."""
    rows = _rows(spark, sf_dir).withColumn("outcome", ev.outcome(F.when(F.col("o_orderkey") % 5 != 0, F.col("label")), F.col("found")))
    return ev.outcome_metrics(rows, "era").select("era", "tp", "fp", "fn", "tn", "accuracy")


@query(
    """SELECT confidence, sum((d = truth)::INT)::BIGINT AS correct, count(*) AS total FROM (SELECT l_orderkey, confidence, arg_min(l_shipdate::DATE, o) AS d, any_value(truth) AS truth FROM (
  SELECT l.*, CASE l_linenumber % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'derived' ELSE 'inferred' END AS confidence, l_linenumber || strftime(l_shipdate, '%Y-%m-%d') AS o, first_value(l_shipdate::DATE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS truth FROM lineitem l) GROUP BY l_orderkey, confidence) GROUP BY confidence"""
)
def calibration(spark, sf_dir):
    """How often each tier's top candidate is right."""
    k = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.concat(F.col("l_linenumber"), day("l_shipdate")).alias("seq"), day("l_shipdate").alias("value"), F.lit("day").alias("precision"), F.lit("published").alias("field"), F.lit("x").alias("source"), F.when(k == 0, "declared").when(k == 1, "derived").otherwise("inferred").alias("confidence"))
    truth = rows.groupBy("page_id").agg(F.min_by("value", "seq").alias("published"), F.lit(None).cast("string").alias("modified"))
    return ev.calibration(rows, truth)


@query(
    """SELECT classes, count(*) AS n, sum(r::INT)::BIGINT AS right, sum(r::INT) / count(*)::DOUBLE AS accuracy FROM (SELECT l_orderkey, count(DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'cms' WHEN 1 THEN 'cms' WHEN 2 THEN 'url' ELSE 'text' END) AS classes, l_orderkey % 3 > 0 AS r
  FROM (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS d, first_value(l_shipdate::DATE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS w FROM lineitem) WHERE abs(date_diff('day', d, w)) % 5 = 0 GROUP BY l_orderkey) GROUP BY classes"""
)
def agreement_classes(spark, sf_dir):
    """Independent kinds of evidence that agree with the winner, and how often it is right."""
    k = F.col("l_linenumber") % 4
    first = F.first("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").withColumn("w", first)
    agrees = F.abs(F.datediff("l_shipdate", "w")) % 5 == 0
    source = F.when(k == 0, "jsonld").when(k == 1, "opengraph").when(k == 2, "url-slug").otherwise("time-tag")
    cands = rows.select(F.col("l_orderkey").alias("page_id"), F.when(agrees, day("w")).otherwise("1990-01-01").alias("value"), F.lit("published").alias("field"), source.alias("source"))
    won = rows.filter("l_shipdate = w").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.first(day("w")).alias("value")).withColumn("label", F.when(F.col("page_id") % 3 > 0, F.col("value")).otherwise("x"))
    return ev.agreement_table(ev.agreement(cands, won), "classes")


@query("SELECT avg(h) FILTER (WHERE s = 'dev') AS dev, avg(h) FILTER (WHERE s = 'test') AS test, avg(h) FILTER (WHERE s = 'dev') - avg(h) FILTER (WHERE s = 'test') AS gap FROM (SELECT (verdict = 'exact')::INT AS h, CASE WHEN ('0x' || substr(sha1(host), 1, 2))::INT % 3 = 0 THEN 'test' ELSE 'dev' END AS s FROM " + _JUDGED + ")")
def split_gap(spark, sf_dir):
    return ev.split_gap(_judged(spark, sf_dir))


@query(f"SELECT count(*) AS n FROM {_JUDGED} WHERE ('0x' || substr(sha1(host), 1, 2))::INT % 3 <> 0 AND o_orderkey % 60 <= 30 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")
def scored_entries(spark, sf_dir):
    """Entries that a score counts: fetched, labelled, of the split, captured in time, answerable."""
    k = F.col("o_orderkey")
    rows = _rows(spark, sf_dir).select("host", (k % 11 != 0).alias("fetched"), F.col("label").alias("published"), (k % 60).alias("capture_lag_days"), F.when(k % 13 == 0, False).alias("label_in_page"))
    return ev.scored_entries(rows).agg(F.count("*").alias("n"))


def _bench(spark, sf_dir):
    """Two tools' answers for each order."""
    rows = _rows(spark, sf_dir).select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("file"), F.col("label").alias("gold"), "found", "o_orderkey")
    a = rows.select(F.lit("a").alias("tool"), "file", "gold", "found", (F.col("o_orderkey") % 10 + 1.0).alias("ms"))
    b = rows.select(F.lit("b").alias("tool"), "file", "gold", F.when(F.col("o_orderkey") % 2 == 0, F.col("gold")).alias("found"), (F.col("o_orderkey") % 4 + 1.0).alias("ms"))
    return a.union(b)


_BENCH = f"(SELECT 'a' AS tool, 'f' || o_orderkey AS file, {_VERDICT} AS verdict, o_orderkey % 10 + 1.0 AS ms FROM orders UNION ALL SELECT 'b', 'f' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'exact' ELSE 'missed' END, o_orderkey % 4 + 1.0 FROM orders)"


@query(f"SELECT tool, {_TALLY}, avg(ms)::DOUBLE AS ms_per_page, median(ms)::DOUBLE AS median_ms FROM {_BENCH} GROUP BY tool")
def leaderboard(spark, sf_dir):
    return ev.leaderboard(_bench(spark, sf_dir))


@query(
    f"""SELECT tool, count(*) FILTER (WHERE v = 'exact') AS exact, count(*) FILTER (WHERE v = 'wrong') AS wrong FROM (SELECT tool, CASE WHEN k % 100 = 0 THEN CASE WHEN verdict = 'missed' THEN 'exact' ELSE 'wrong' END WHEN k % 100 = 50 THEN CASE WHEN verdict = 'missed' THEN 'missed' ELSE 'wrong' END ELSE verdict END AS v
  FROM (SELECT *, substr(file, 2)::BIGINT AS k FROM {_BENCH})) GROUP BY tool"""
)
def corrected_leaderboard(spark, sf_dir):
    """The same against corrected answers; where none is right, any answer is wrong."""
    k = F.col("o_orderkey") % 100
    fixes = table(spark, sf_dir, "orders").filter(k.isin(0, 50)).select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("file"), F.when(k == 50, "1980-01-01").alias("corrected"))
    rows = ev.corrected(_bench(spark, sf_dir), fixes)
    return rows.groupBy("tool").agg(F.count_if(F.col("verdict") == "exact").alias("exact"), F.count_if(F.col("verdict") == "wrong").alias("wrong"))


@query("SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_first, count(*) FILTER (WHERE NOT a AND b) AS only_second, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT o_orderkey % 7 > 3 AS a, o_orderkey % 2 = 0 AS b FROM orders)")
def head_to_head(spark, sf_dir):
    return ev.head_to_head(_bench(spark, sf_dir), "a", "b")


@query("SELECT CASE WHEN o_orderkey % 7 > 3 THEN 'a' WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'neither' END AS bucket, count(*) AS n FROM orders WHERE NOT (o_orderkey % 7 > 3 AND o_orderkey % 2 = 0) AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 2 = 1) GROUP BY bucket")
def tool_disagreements(spark, sf_dir):
    return ev.disagreements(_bench(spark, sf_dir), "a", "b").groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 > 3 AND o_orderkey % 9 > 0) AS same, count(*) FILTER (WHERE o_orderkey % 7 <= 3) AS different_answer, count(*) FILTER (WHERE o_orderkey % 7 > 3 AND o_orderkey % 9 = 0) AS different_candidates FROM orders")
def parity(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    a = rows.select(F.col("o_orderkey").alias("page_id"), F.col("label").alias("published"), F.lit(None).cast("string").alias("modified"), F.lit(1).alias("n"))
    b = rows.select(F.col("o_orderkey").alias("page_id"), F.col("found").alias("published"), F.lit(None).cast("string").alias("modified"), F.when(F.col("o_orderkey") % 9 == 0, 2).otherwise(1).alias("n"))
    return ev.parity(a, b)


@query("SELECT CASE WHEN o_orderkey % 7 > 3 THEN 'right' WHEN o_orderkey % 2 = 0 THEN 'ranking' WHEN o_orderkey % 7 > 0 THEN 'wrong' ELSE 'missing' END AS state, count(*) AS n FROM orders GROUP BY state")
def triage(spark, sf_dir):
    values = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("1980-01-01"), F.col("label")))
    return _rows(spark, sf_dir).groupBy(ev.triage(F.col("label"), F.col("found"), values).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT era, count(*) AS n, count(DISTINCT host) AS hosts FROM " + _JUDGED + " GROUP BY era")
def harvest_summary(spark, sf_dir):
    return ev.harvest_summary(_rows(spark, sf_dir))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n <= 4 OR k IN (0, floor(n / 4)::BIGINT, floor(n / 2)::BIGINT, floor(3 * n / 4)::BIGINT)")
def stride_sample(spark, sf_dir):
    """A sampling operator: four evenly spaced rows of each key."""
    return ev.stride(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", 4, key="o_custkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def domain_quota(spark, sf_dir):
    return ev.quota(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


_LINES = ["https://h.example/{}", "# comment {}", "ftp://h.example/{}", '{{"url": "https://h.example/{}", "id": 7}}', '{{"url": 5, "id": {}}}', "{{broken {}", "[{}]"]
_STATES = ["ok", None, "not an http(s) URL", "ok", 'missing or invalid "url"', "malformed JSON", "not an http(s) URL"]


def _lines(spark, sf_dir):
    made = [F.format_string(x.replace("{}", "%d").replace("{{", "{").replace("}}", "}").replace("%d", "%d"), F.col("o_orderkey")) for x in _LINES]
    line = F.element_at(F.array(*made), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"), line.alias("value"))


@query("SELECT index, state AS error, url FROM (SELECT o_orderkey AS index, o_orderkey % 7 AS k, CASE WHEN o_orderkey % 7 IN (0, 3) THEN 'https://h.example/' || o_orderkey END AS url FROM orders) JOIN (VALUES " + ", ".join(f"({k}, {repr(s) if s != 'ok' else 'NULL'})" for k, s in enumerate(_STATES) if s) + ") t(k, state) USING (k)")
def batch_parse_lines(spark, sf_dir):
    """Lines of URLs and JSON objects, good and bad."""
    return batch.parse_lines(_lines(spark, sf_dir)).select("index", "error", "url")


@query("SELECT coalesce(e, 'dated') AS state, count(*) AS n FROM (SELECT CASE o_orderkey % 7 WHEN 2 THEN 'not an http(s) URL' WHEN 6 THEN 'not an http(s) URL' WHEN 4 THEN 'missing or invalid \"url\"' WHEN 5 THEN 'malformed JSON' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'unreachable' END END AS e FROM orders WHERE o_orderkey % 7 <> 1) GROUP BY state")
def batch_records(spark, sf_dir):
    """A record for each line, unreachable pages and bad lines among them."""
    crawled = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").select(F.format_string("https://h.example/%d", "o_orderkey").alias("url"), day("o_orderdate").alias("published"), F.lit(None).cast("string").alias("modified"), F.lit(None).cast("string").alias("conflict"))
    rows = batch.records(batch.by_host(batch.parse_lines(_lines(spark, sf_dir))), crawled)
    return rows.groupBy(F.coalesce("error", F.lit("dated")).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE event_id % 3 = 0) AS replaced FROM (SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0 OR ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY)")
def cache_merge(spark, sf_dir):
    """Kept results that still hold, with fresh ones in place of their URL's."""
    events = table(spark, sf_dir, "events")
    cache = events.select(F.col("event_id").cast("string").alias("url"), F.lit("old").alias("result"), F.col("ts").alias("fetched_at"), F.lit(3).alias("version"))
    fresh = events.filter("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("url"), F.lit("new").alias("result"), F.col("ts").alias("fetched_at"), F.lit(3).alias("version"))
    merged = batch.merge_cache(batch.fresh_cache(cache, F.lit("2024-01-20").cast("timestamp")), fresh)
    return merged.agg(F.count("*").alias("entries"), F.count_if(F.col("result") == "new").alias("replaced"))


@query("SELECT user_id::VARCHAR AS url, arg_max(event_type, event_id) AS result, max(event_id) AS generation FROM events GROUP BY user_id")
def latest_result(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("result"), F.col("event_id").alias("generation"))
    return batch.latest_result(rows)


@query(
    """SELECT o_custkey AS results_page, url FROM (SELECT o_custkey, 'https://h.example/' || (o_orderkey % 500) AS url, min(o_orderkey) AS o FROM orders WHERE o_orderkey % 500 % 10 <> 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o) <= 10"""
)
def fetch_budget(spark, sf_dir):
    """Links still to be fetched: not yet seen, ten to a results page."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.concat(F.lit("https://h.example/"), F.col("o_orderkey") % 500).alias("url")).agg(F.min("o_orderkey").alias("ord"))
    seen = spark.range(0, 500, 10).select(F.concat(F.lit("https://h.example/"), F.col("id")).alias("url"))
    return batch.to_fetch(rows.withColumnRenamed("o_custkey", "results_page"), seen).select("results_page", "url")


@query("SELECT count(*) AS lines, sum(length('{\"o_orderkey\":' || o_orderkey || ',\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"}'))::BIGINT AS chars FROM orders")
def ndjson_records(spark, sf_dir):
    """Records as JSON lines."""
    rows = batch.to_ndjson(table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("day")))
    return rows.agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))
