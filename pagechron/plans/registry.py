"""Where the catalogue's modules register their queries, each with its SQL if it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: The catalogue's clock.
NOW = "2002-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = (run, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def day(x: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.col(x) if isinstance(x, str) else x, fmt)


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows over all cores, where what is made of each is far larger or dearer than itself."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
