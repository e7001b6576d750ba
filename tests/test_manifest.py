"""Manifests are replaced whole or not at all."""

import pytest
from pyspark.sql import functions as F

from pagechron.sources.files import MANIFEST, POINTER, read_manifest, write_manifest


def entries(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string").select(*(F.col("id") if c == "id" else F.lit(None).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in spark.createDataFrame([], MANIFEST).schema)))


def ids(spark, path):
    return sorted(r.id for r in read_manifest(spark, path).collect())


def test_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    write_manifest(entries(spark, "a"), path)
    write_manifest(entries(spark, "b", "c"), path)
    reader = read_manifest(spark, path)
    write_manifest(entries(spark, "d"), path)
    assert sorted(r.id for r in reader.collect()) == ["b", "c"]  # the version before is still there to be read
    assert ids(spark, path) == ["d"]
    assert len(list((tmp_path / "m").glob("v-*"))) == 2
    write_manifest(read_manifest(spark, path).limit(0), path)  # from itself
    assert ids(spark, path) == []


def test_a_failed_task_leaves_the_old_one(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    write_manifest(entries(spark, "old1", "old2"), path)
    pointer = (tmp_path / "m" / POINTER).read_text()
    broken = entries(spark, "new", "bad").withColumn("id", F.when(F.col("id") == "bad", F.raise_error("no entry")).otherwise(F.col("id")).cast("string"))
    with pytest.raises(Exception, match="no entry"):
        write_manifest(broken, path)
    assert (tmp_path / "m" / POINTER).read_text() == pointer
    assert ids(spark, path) == ["old1", "old2"]


def test_plain_files_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"x"}\n\n{"id":"y"}\n')
    assert ids(spark, f"file://{tmp_path}/m.jsonl") == ["x", "y"]
