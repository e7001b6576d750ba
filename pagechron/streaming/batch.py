"""Lines of URLs in, records out: as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..functions.urls import has_web_scheme, host_of

#: Version and life of a kept result.
CACHE_VERSION, CACHE_DAYS = 3, 7
#: Pages that one results page may have fetched.
FETCH_BUDGET = 10


def parse_line(raw: Column) -> Column:
    """Struct of ok, url, extra (the other keys, as variant) and error; null for blank lines and comments."""
    line = trim(raw)
    parsed = F.try_parse_json(line)
    url = F.try_variant_get(parsed, "$.url", "string")
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.url", "variant")) == "STRING"
    record = lambda ok, u, extra, error: F.struct(F.lit(ok).alias("ok"), u.alias("url"), extra.alias("extra"), F.lit(error).cast("string").alias("error"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("variant")
    bare = F.when(has_web_scheme(line), record(True, line, nothing, None)).otherwise(record(False, none, nothing, "not an http(s) URL"))
    good = F.coalesce(is_text & has_web_scheme(url), F.lit(False))
    json = F.when(parsed.isNull(), record(False, none, nothing, "malformed JSON")).when(good, record(True, url, parsed, None)).otherwise(record(False, none, nothing, 'missing or invalid "url"'))
    return F.when((line != "") & ~line.startswith("#"), F.when(line.startswith("{"), json).otherwise(bare))


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """value and, in a batch, index (the line's place in its file)."""
    if stream:
        return spark.readStream.text(path)
    # large files are read in blocks; a block's lines begin where those before it end
    at = ("_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS id")
    lines = spark.read.text(path).selectExpr("value", *at)
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("index"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines with url, ok, extra, error and, for bad ones, input; what says nothing is dropped."""
    rows = lines.withColumn("_line", parse_line(F.col("value"))).filter("_line IS NOT NULL")
    return rows.select(*[c for c in lines.columns if c != "value"], "_line.*", F.when(~F.col("_line.ok"), trim(F.col("value"))).alias("input"))


def by_host(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Lines of one host in one task, so that no host is asked twice at once."""
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    return lines.repartition(partitions, host) if partitions else lines.repartition(host)


def records(lines: DataFrame, resolved: DataFrame, all_candidates: bool = False) -> DataFrame:
    """A record for each line: its dates, or why there are none. No line stops the others."""
    found = resolved.select("url", F.lit(True).alias("_found"), "published", "modified", "conflict", *(["candidates"] if all_candidates else []))
    rows = lines.join(found, "url", "left")
    error = F.coalesce(F.col("error"), F.when(F.col("_found").isNull(), "unreachable"))
    return rows.withColumn("error", error).drop("_found")


def to_ndjson(rows: DataFrame) -> DataFrame:
    """One JSON object a line: the line's own keys first, then the engine's, which win."""
    if "extra" not in rows.columns:
        return rows.select(F.to_json(F.struct("*")).alias("value"))
    own = [c for c in rows.columns if c != "extra"]
    kept = F.map_filter(F.try_variant_get("extra", "$", "map<string,variant>"), lambda k, _: ~k.isin(*own))
    theirs, ours = F.to_json(kept), F.to_json(F.struct(*own))
    both = rows.select(theirs.alias("theirs"), ours.alias("ours"))
    return both.select(F.when(F.length("theirs") > 2, F.expr("concat(left(theirs, length(theirs) - 1), ',', substring(ours, 2))")).otherwise(F.col("ours")).alias("value"))


def exit_status(rows: DataFrame, one_page: bool = False) -> Column:
    """0 if a date was found, 1 if none, as an aggregate of records; 2 if the one page asked for couldn't be read."""
    found = F.count_if(F.col("published").isNotNull() | F.col("modified").isNotNull()) > 0
    unread = F.count_if(F.col("error").isNull()) == 0
    return F.when(found, 0).when(unread & F.lit(one_page), 2).otherwise(1)


def stream_records(lines: DataFrame, pages: DataFrame, find, now: Column) -> DataFrame:
    """A stream of lines joined to crawled pages and dated: stateless, in order of arrival.

    ``find`` dates the static pages once; the stream only looks them up.
    """
    return records(parse_lines(lines), find(pages, now))


def fresh_cache(cache: DataFrame, now: Column) -> DataFrame:
    """Kept results (url, result, fetched_at, version) that still hold."""
    return cache.filter((F.col("version") == CACHE_VERSION) & (F.col("fetched_at") > now - F.expr(f"INTERVAL {CACHE_DAYS} DAYS")))


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows in place of those with their URL."""
    return cache.join(fresh.select("url"), "url", "left_anti").unionByName(fresh)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("chars"))


def clear_cache(cache: DataFrame, host: str | None = None) -> DataFrame:
    """The cache without the results of a host, or of all."""
    return cache.filter(F.coalesce(host_of(F.col("url")) != host, F.lit(True))) if host else cache.limit(0)


def dedupe_stream(events: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """A stream's first event of each key, forgotten after the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latest_result(results: DataFrame) -> DataFrame:
    """Per URL the result of the largest generation."""
    return results.groupBy("url").agg(F.max_by("result", "generation").alias("result"), F.max("generation").alias("generation"))


def to_fetch(links: DataFrame, seen: DataFrame, budget: int = FETCH_BUDGET) -> DataFrame:
    """Links (results_page, ord, url) without a date in their URL, not seen, within each page's budget."""
    rows = links.filter(has_web_scheme(F.col("url"))).dropDuplicates(["results_page", "url"]).join(seen.select("url"), "url", "left_anti")
    place = F.row_number().over(Window.partitionBy("results_page").orderBy("ord"))
    return rows.withColumn("_n", place).filter(F.col("_n") <= budget).drop("_n")
