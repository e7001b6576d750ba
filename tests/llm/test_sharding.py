import random
import zlib

import pytest

from pagechron.llm.sharding import shard_by_bytes, write_shards


def check(rows, n):
    sizes = [0] * n
    for r in rows:
        sizes[r.shard] += r.size
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return sizes


def test_balance_and_order(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(3000)], "doc_id long, text string")
    rows = shard_by_bytes(docs, 24).collect()
    assert len(rows) == 3000
    sizes = check(rows, 24)
    assert max(sizes) - min(sizes) <= 2 * (97 + 8)
    assert all(r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 97)) and r.size == r.doc_id % 97 + 8 for r in rows)


def test_a_third_of_the_rows_are_copies(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sizes = check(shard_by_bytes(docs, 24).collect(), 24)
    assert max(sizes) - min(sizes) <= 40


def test_odd_rows(odd_docs):
    rows = shard_by_bytes(odd_docs, 3).collect()
    assert len(rows) == 9
    check(rows, 3)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {8}


def test_empty(odd_docs):
    assert shard_by_bytes(odd_docs.limit(0), 3).collect() == []


def plain(rows, n):
    """(doc_id, crc) to shard and slot by sums over all rows, in the operator's order of hashes and ids."""
    total, at, out, slots = sum(r.size for r in rows), 0, [], [0] * n
    for r in rows:
        shard = min(n - 1, (2 * at + r.size) * n // (2 * total))
        out.append((r.doc_id, r.crc, shard, slots[shard]))
        slots[shard] += 1
        at += r.size
    return out


@pytest.mark.parametrize("n", [1, 7, 24])
def test_equals_plain_prefix_sums(spark, n):
    """Against one running sum over all rows; shards are contiguous in that order."""
    rng = random.Random(n)
    docs = spark.createDataFrame([(k, "copy" * 9 if k % 3 == 0 else "é" * rng.randrange(60)) for k in range(1500)], "doc_id long, text string").repartition(5)
    ordered = docs.selectExpr("doc_id", "octet_length(text) + 8 AS size", "crc32(CAST(text AS BINARY)) AS crc", "xxhash64(text) AS grp").orderBy("grp", "doc_id").collect()
    want = plain(ordered, n)
    assert [s for *_, s, _ in want] == sorted(s for *_, s, _ in want)
    assert sorted((r.doc_id, r.text_crc32, r.shard, r.slot) for r in shard_by_bytes(docs, n).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 24])
def test_write(spark, tmp_path, n):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    write_shards(docs, n, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(i, f"t{i}") for i in range(50)]
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_write_keeps_every_row_and_column(spark, odd_docs, tmp_path):
    write_shards(odd_docs, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*odd_docs.columns, "shard_", "slot"}
    key = lambda r: tuple(str(r[c]) for c in odd_docs.columns)
    assert sorted(map(key, back.collect())) == sorted(map(key, odd_docs.collect()))
    write_shards(odd_docs.limit(0), 4, str(tmp_path / "none"))
