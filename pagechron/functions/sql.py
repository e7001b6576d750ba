"""The engine's functions for SQL text: scalars, table functions, views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import Options, candidates, flat
from ..plans.resolve import resolve
from ..sources.html import page_nodes, prepare
from .dates import DAY_MS, to_interval_ms
from .guard import absolute, is_safe
from .verdicts import page_text


def register(spark: SparkSession) -> None:
    """is_safe_fetch_target(url), absolute_url(base, href) and the table function page_nodes(html, host)."""
    prepare(spark)

    @F.pandas_udf("boolean")
    def safe(urls: pd.Series) -> pd.Series:
        return urls.map(is_safe, na_action=None)

    @F.pandas_udf("string")
    def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([absolute(b, h) for b, h in zip(base, href, strict=True)], dtype=object)

    @F.udtf(returnType="kind string, seq int, key string, raw string, text string, marker string")
    class Nodes:
        def eval(self, html: str, host: str):
            for n in page_nodes(html, host, True):
                yield tuple(n.get(k) for k in ("kind", "seq", "key", "raw", "text", "marker"))

    spark.udf.register("is_safe_fetch_target", safe)
    spark.udf.register("absolute_url", resolved)
    spark.udtf.register("page_nodes", Nodes)


def _ages(resolved: DataFrame, now: Column) -> DataFrame:
    """url, basis, value and the least and most days that each page's date can be old, by what the age is reckoned from."""
    used = {"either": F.coalesce("modified", "published"), "published": F.col("published"), "modified": F.col("modified")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("basis"), d.alias("d")) for k, d in used.items()))).alias("u")
    rows = resolved.select("url", each).select("url", "u.basis", "u.d").withColumn("span", to_interval_ms(F.col("d.value"), F.col("d.precision")))
    days = lambda ms: (F.unix_millis(now.cast("timestamp")) - ms) / DAY_MS
    return rows.select("url", "basis", F.col("d.value").alias("value"), days(F.col("span.end_ms") - 1).alias("least_days"), days(F.col("span.start_ms")).alias("most_days"))


#: Table functions over the views, by name: parameters, columns and query. In a query over many pages each is one join.
FUNCTIONS = {
    "page_date": (
        "page_url STRING",
        "published STRING, published_source STRING, published_confidence STRING, modified STRING, conflict STRING, text STRING",
        "SELECT published_value, published_source, published_confidence, modified_value, conflict_kind, text FROM {0}page_dates WHERE url = page_url",
    ),
    "page_candidates": (
        "page_url STRING",
        "pos INT, value STRING, precision STRING, field STRING, source STRING, confidence STRING, note STRING",
        "SELECT pos, value, precision, field, source, confidence, note FROM {0}candidates WHERE url = page_url",
    ),
    "page_freshness": (
        "page_url STRING, threshold INT, reckoned STRING DEFAULT 'either'",
        "stale BOOLEAN, reason STRING, value STRING, age_days BIGINT, max_age_days BIGINT",
        "SELECT CASE WHEN most_days <= threshold THEN false WHEN least_days > threshold THEN true END, CASE WHEN least_days IS NULL THEN 'no-date' WHEN most_days <= threshold THEN 'fresh' WHEN least_days > threshold THEN 'stale' ELSE 'imprecise' END, "
        "value, CAST(floor(least_days) AS BIGINT), CAST(floor(most_days) AS BIGINT) FROM {0}page_ages WHERE url = page_url AND basis = reckoned",
    ),
}


def create_views(pages: DataFrame, now: Column, options: Options | None = None, prefix: str = "") -> None:
    """Views ``candidates`` (page_id, url, pos, value, ...), ``page_dates`` (one flat row a page, with its text) and ``page_ages``, and the table functions over them.

    ``page_date(url)``, ``page_candidates(url)`` and ``page_freshness(url, threshold,
    reckoned)`` answer for one page or, after LATERAL, for each row of a query.
    """
    found = candidates(pages, options, now)
    dated = resolve(found, now)
    found.select("page_id", "url", F.posexplode("candidates").alias("pos", "c")).select("page_id", "url", "pos", "c.*").createOrReplaceTempView(f"{prefix}candidates")
    flat(dated, page_text(F.col("url"), F.col("published"), F.col("modified"), F.col("conflict")).alias("text")).createOrReplaceTempView(f"{prefix}page_dates")
    _ages(dated, now).createOrReplaceTempView(f"{prefix}page_ages")
    for name, (parameters, columns, query) in FUNCTIONS.items():
        pages.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {query.format(prefix)}")
