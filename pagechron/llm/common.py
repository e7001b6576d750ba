"""Shared plumbing: scratch tables on the shared folder, prefix sums, components."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import prepare, scratch, shared_folder  # noqa: F401  prepare: for the operators

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files.

    This cuts the lineage: a lost executor costs only the files' rereading, and
    work done before is neither repeated nor evaluated twice.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all staged tables of this application, once no DataFrame over them is needed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bases(totals: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Exclusive running sums of per-partition totals, one row per partition.

    ``totals`` has one row per partition number ``key``; its size is the number
    of partitions, whatever the number of rows, so the driver may hold it.
    """
    rows = sorted(totals.select(key, *values).collect())
    sums = [[0, *accumulate(r[1 + i] for r in rows)] for i in range(len(values))]
    out = [(r[0], *(int(s[k]) for s in sums)) for k, r in enumerate(rows)]
    schema = f"{key} int, " + ", ".join(f"{v}_before long" for v in values)
    return F.broadcast(totals.sparkSession.createDataFrame(out, schema))


def without(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` but for ids that name none of their components in ``groups`` (doc_id, component_id).

    Only the ids that go are joined, which are mostly few.
    """
    name = "_gone" + "_" * max(map(len, docs.columns), default=0)  # no column's name
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = groups.groupBy(F.col("doc_id").alias(name)).agg(stays.alias("_stays")).filter("NOT _stays").select(name)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links, u != v, to (node, root): root is the least id of the component.

    Alternating large-star and small-star steps. Each step is a grouped minimum
    (combined before the shuffle) and a join that adaptive execution splits where
    a node has very many links; each round's links are written to the shared
    folder. Ids are compared as signed longs. Nodes without links don't appear.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        near = both(e)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        return near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 999983)).first())

    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    was = sign(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        then, now = now, stage(small(large(now)), "links")
        release(then)
        mark = sign(now)
        if mark == was:
            break
        was = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; label[x] is the least index of x's class."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
