"""Contiguous shards of nearly equal bytes, by global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bases, stage

#: Counted for each row besides its text.
ROW_OVERHEAD = 8


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the row's overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row, under the law ``bytes``.

    Rows are put in the order of (hash of text, id), so equal texts lie together
    and only a group that a shard's end falls into is divided. Each range
    partition's bytes are summed; the exclusive sums of these totals give every
    row its global byte position. The row's middle, cut at n equal targets, is
    its shard; shards are contiguous in that order, and their sizes differ from
    the target by no more than one row at either end. A group of copies with a
    third of all rows is spread like any other rows. Only ids, sizes and hashes
    are shuffled.

    Null and empty texts have size 8 and crc 0; null ids are kept; repeated rows
    each get their own slot; an empty table gives no rows; other columns of
    ``docs`` are ignored. With fewer rows than shards, some shards are empty.
    """
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("grp"),
    )
    narrow = stage(narrow, "sizes")
    placed = stage(narrow.repartitionByRange("grp", "doc_id").withColumn("pid", F.spark_partition_id()), "ranges")
    totals = stage(placed.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "totals")
    total = totals.agg(F.coalesce(F.sum("bytes"), F.lit(1))).first()[0]

    order = Window.partitionBy("pid").orderBy("grp", "doc_id")
    sums = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        placed.withColumn("upto", F.sum("size").over(sums))
        .withColumn("rn", F.row_number().over(order).cast("long"))
        .join(bases(totals, "pid", ["bytes"]), "pid")
        .withColumn("twice", (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"(twice * {n_shards}) div (2 * {total})"), F.lit(n_shards - 1)).cast("int"))
    )
    # one row for each partition and shard it reaches: partitions + shards at most
    parts = sorted(rows.groupBy("shard", "pid").agg(F.min("rn").alias("first"), F.count("*").alias("n")).collect())
    start, before = [], {}
    for shard, pid, first, n in parts:
        start.append((shard, pid, before.get(shard, 0) - first))
        before[shard] = before.get(shard, 0) + n
    starts = F.broadcast(docs.sparkSession.createDataFrame(start, "shard int, pid int, shift long"))
    return rows.join(starts, ["shard", "pid"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rn") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _free(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def write_shards(docs: DataFrame, n_shards: int, path: str, text_col: str = "text") -> None:
    """Place all rows as ``shard_by_bytes`` does and write them under path/shard=N, in the order of their slots.

    Every row is written once, with all its columns: rows are numbered and written
    before they are placed, so null and repeated ids, and repeated rows, are
    neither lost nor multiplied. Where ``docs`` has a column shard or slot of its
    own, the new one's name gets an underscore more. An empty table writes no rows.
    """
    row, shard, slot = (_free(docs.columns, name) for name in ("row", "shard", "slot"))
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    where = shard_by_bytes(rows, n_shards, row, text_col).select(F.col("doc_id").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = rows.join(where, row).drop(row)
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
