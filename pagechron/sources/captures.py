"""Capture listings kept in key order: landed once, read by ranges of keys, times and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stage

CAPTURE = "urlkey string, timestamp string, original string, statuscode string, mimetype string, digest string, length long"


def url_key(url: Column) -> Column:
    """The key that listings sort by: labels of the host from the last to the first, then the path; no scheme, no leading www."""
    bare = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:www\\d*\\.)?", "")
    host, rest = F.regexp_extract(bare, "^[^/?#]*", 0), F.regexp_replace(F.regexp_extract(bare, "[/?].*$", 0), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, ":(?:80|443)$", ""), "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def land_captures(rows: DataFrame, path: str) -> None:
    """Write captures (all of CAPTURE but urlkey) as Parquet, sorted by key and time.

    Keys are dealt by ranges, so a file and each of its row groups hold a narrow
    range of keys that readers skip by its bounds; a key with very many captures
    is divided by time.
    """
    keyed = rows.withColumn("urlkey", url_key(F.col("original"))).select(*(c.split()[0] for c in CAPTURE.split(", ")))
    keyed.repartitionByRange("urlkey", "timestamp").sortWithinPartitions("urlkey", "timestamp").write.parquet(path)


def _after(prefix: str) -> str | None:
    """The least text above all that begin with the prefix."""
    bare = prefix.rstrip("\U0010ffff")
    if not bare:
        return None
    last = ord(bare[-1]) + 1
    return bare[:-1] + chr(0xE000 if last == 0xD800 else last)  # no character is a surrogate


def read_captures(spark: SparkSession, path: str, prefix: str | None = None, since: str | None = None, until: str | None = None, status: str | None = "200", mime: str | None = "text/html") -> DataFrame:
    """Captures of one range of keys, from ``since`` up to before ``until``, of a status and a type.

    Every condition is a comparison of a stored column, so all of them reach the scan.
    """
    rows = spark.read.schema(CAPTURE).parquet(path)
    if prefix:
        rows = rows.filter(F.col("urlkey") >= prefix)
        if (end := _after(prefix)) is not None:
            rows = rows.filter(F.col("urlkey") < end)
    if since:
        rows = rows.filter(F.col("timestamp") >= since)
    if until:
        rows = rows.filter(F.col("timestamp") < until)
    for column, value in (("statuscode", status), ("mimetype", mime)):
        rows = rows.filter(F.col(column) == value) if value else rows
    return rows


def collapse(captures: DataFrame, digits: int | None = None) -> DataFrame:
    """The earliest capture of each key, or of each key and leading ``digits`` of the time.

    A minimum, combined before the shuffle: a key with very many captures sends one row from each task.
    """
    keys = ["urlkey"] if digits is None else ["urlkey", F.left("timestamp", F.lit(digits)).alias("_period")]
    rest = [c for c in captures.columns if c != "urlkey"]
    least = captures.groupBy(*keys).agg(F.min(F.struct("timestamp", *(c for c in rest if c != "timestamp"))).alias("_r"))
    return least.select("urlkey", *(F.col("_r")[c].alias(c) for c in rest))


def positions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with _at, their place (from 0) among those of their key in order, and _of, how many those are.

    Rows are ranked in ranges of (key, order), each range by itself; where a range
    begins among its key's rows comes from the sums of the ranges before it, so a
    key with any share of the rows is spread over as many tasks as it fills.
    ``order`` must leave no ties for the places to be the same in every run.
    """
    ranges = stage(rows.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()), "ranges")
    # a row for each key in each range
    totals = ranges.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumns({"_before": before, "_of": F.sum("_n").over(own)}).drop("_n")
    place = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)) - 1
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("_pid", *keys)]
    joined = ranges.withColumn("_local", place).alias("a").join(starts.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("_local") + F.col("_before")).alias("_at"), "_of")
