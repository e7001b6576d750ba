"""Building a corpus: where to sample, which feed a site has, what a run has done already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.captures import positions
from ..sources.html import nodes
from ..sources.side_documents import page_links

# The years that are sampled, rows looked at for a month, and where feeds usually are.
YEARS = (2006, 2009, 2012, 2015, 2018, 2021, 2023, 2025)
MONTH_WINDOW = 1500
OVERSAMPLE = 12
FEED_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/index.xml", "/feed.xml")
FEED_BODY = "(?i)<(rss|feed|rdf:RDF)[\\s>]"
#: Step of the phases of sample points, so that neighbours don't begin at the same place of their month.
PHASE = 0.618


def sample_points(years: tuple[int, ...] = YEARS) -> list[tuple[int, int, float]]:
    """(year, month, phase): two months of each year, walking through the calendar."""
    months = [(y, (5 * i + 6 * half) % 12 + 1) for i, y in enumerate(years) for half in (0, 1)]
    return [(y, m, (k * PHASE) % 1) for k, (y, m) in enumerate(months)]


def sampled_quota(captures: DataFrame, per_domain: int = 60, years: tuple[int, ...] = YEARS, window: int = MONTH_WINDOW, domain: str = "domain", path: str = "path", order: str = "urlkey") -> DataFrame:
    """Of each domain an equal number of captures from each sample point, evenly spaced in key order.

    A point's captures are those whose path begins with its year and month; the
    month without its zero counts only where a domain has none with it. The first
    ``window`` of them in order are strided over. A domain with any share of all
    rows is ranked by ranges in many tasks.
    """
    spark, want = captures.sparkSession, max(1, round(per_domain / (2 * len(years))))
    points = spark.createDataFrame([(k, f"{y}/{m:02d}", f"{y}/{m}" if m < 10 else None, p) for k, (y, m, p) in enumerate(sample_points(years))], "point int, padded string, short string, phase double")
    bare = F.regexp_replace(F.col(path), "^/", "")
    under = lambda name: F.coalesce(bare.startswith(F.col(name)), F.lit(False))
    rows = captures.join(F.broadcast(points), under("padded") | under("short")).withColumn("_short", ~under("padded"))
    # a short month is a prefix of other months too (2015/1 of 2015/12), so only its own path counts
    rows = rows.filter(~F.col("_short") | F.coalesce(bare.startswith(F.concat("short", F.lit("/"))), F.lit(False)))
    padded = rows.filter("NOT _short").select(F.col(domain).alias("_d"), F.col("point").alias("_p")).distinct()
    rows = rows.join(padded, F.col(domain).eqNullSafe(F.col("_d")) & (F.col("point") == F.col("_p")) & F.col("_short"), "left_anti")
    most = max(window, want * OVERSAMPLE)
    placed = positions(rows.drop("padded", "short", "_short"), [domain, "point"], [order]).filter(F.col("_at") < most).withColumn("_of", F.least("_of", F.lit(most)))
    step = F.col("_of") / F.lit(want)
    picks = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.floor((i + F.col("phase")) * step) % F.col("_of"))
    return placed.filter((F.col("_of") <= want) | F.array_contains(picks, F.col("_at").cast("bigint"))).drop("_at", "_of", "phase")


def find_feeds(homes: DataFrame, probes: DataFrame) -> DataFrame:
    """host and feed of each site (host, html; html may be null): its declared link, else the first usual path with a feed.

    ``probes`` (url, body) are what the usual paths have answered. A site without
    either has a null feed. Repeated hosts count once, the first link in any of
    their pages wins.
    """
    origin = F.concat(F.lit("https://"), F.regexp_extract("host", "^[^/]*", 0))
    sites = homes.select("host", origin.alias("url"), "html").withColumn("page_id", F.xxhash64("host"))
    links = page_links(nodes(sites.filter("html IS NOT NULL"), False))
    declared = F.array_contains(F.split("rel", "\\s+"), F.lit("alternate")) & F.lower("type").rlike("rss|atom|xml") & F.col("target").isNotNull()
    own = links.filter(declared).select("url", F.lit(-1).alias("k"), F.col("ord"), F.col("target").alias("feed"))
    paths = F.posexplode(F.array(*(F.lit(p) for p in FEED_PATHS))).alias("k", "path")
    asked = sites.select("url").distinct().select("url", paths).withColumn("feed", F.concat("url", "path"))
    answered = probes.filter(F.col("body").rlike(FEED_BODY)).select(F.col("url").alias("feed")).distinct()
    # neither side fits the driver for sure, however small its shuffle is when compressed: no broadcast
    usual = asked.join(answered.hint("merge"), "feed").select("url", "k", F.lit(0).alias("ord"), "feed")
    first = own.unionByName(usual).groupBy("url").agg(F.min(F.struct("k", "ord", "feed")).alias("r"))
    return sites.select("host", "url").distinct().join(first.hint("merge"), "url", "left").select("host", F.col("r.feed").alias("feed"))


def resumable(seeds: DataFrame, ledger: str, harvest: Callable[[DataFrame], DataFrame], entries: str, key: str = "seed") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that harvests what no run has finished, and can be killed anywhere.

    A batch's entries and then its ledger go to folders named by the batch's
    number, each replaced whole: a batch that is run again writes the same folders
    anew. Only seeds whose harvest didn't fail (``failed`` null or false) are
    entered as done, so that others are tried again. ``seeds`` gives the schema.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = read_ledger(spark, ledger, key, seeds.schema[key].dataType.simpleString()).filter(F.col("batch") < number)
        todo = batch.dropDuplicates([key]).join(done.select(key), key, "left_anti")
        found = harvest(todo)
        if "failed" not in found.columns:
            found = found.withColumn("failed", F.lit(False))
        found.write.mode("overwrite").parquet(f"{entries}/batch={number}")
        failed = spark.read.parquet(f"{entries}/batch={number}").filter("failed").select(key).distinct()
        todo.select(key).join(failed, key, "left_anti").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return run


def read_ledger(spark: SparkSession, ledger: str, key: str = "seed", kind: str = "string") -> DataFrame:
    """key and batch of what has been done; no rows before the first batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{key} {kind}, batch int")
    return spark.read.schema(f"{key} {kind}, batch int").parquet(ledger)
