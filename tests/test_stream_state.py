"""Stateful streams: hosts, lifetimes, restarts."""

import time

import pytest
from pyspark.sql import functions as F

from pagechron.streaming.state import cached_stream, indexed_lines, stream_lines, use_state_store


@pytest.fixture
def store(spark):
    use_state_store(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for key in ("providerClass", "encodingFormat"):
        spark.conf.unset(f"spark.sql.streaming.stateStore.{key}")


def land(folder, name, text):
    """A file appears whole."""
    (folder.parent / name).write_text(text)
    (folder.parent / name).rename(folder / name)


def until(spark, run, path, enough, schema, seconds=90):
    """Rows of a sink once there are enough."""
    end = time.time() + seconds
    while time.time() < end:
        if run.exception():
            raise run.exception()
        rows = spark.read.schema(schema).parquet(str(path)).collect() if list(path.glob("*.parquet")) and (path / "_spark_metadata").exists() else []
        if len(rows) >= enough:
            return rows
        time.sleep(0.5)
    raise AssertionError("the stream gave too few rows")


def test_one_line_of_a_host_at_a_time(spark, store, tmp_path):
    """No two lines of a host overlap, each has its index, a restart loses and repeats none."""
    (tmp_path / "in").mkdir()
    lines = [f"https://h{k % 3}.example/{k}" for k in range(12)]
    land(tmp_path / "in", "a.txt", "\n".join([*lines[:6], "# note", "nope", *lines[6:]]))
    schema = "index long, url string, error string, started_ms long, finished_ms long"

    def start():
        out = stream_lines(indexed_lines(spark, str(tmp_path / "in")), 150)
        return out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="50 milliseconds").start(str(tmp_path / "out"))

    run = start()
    before = until(spark, run, tmp_path / "out", 4, schema)
    run.stop()
    assert len(before) < 13  # lines were still waiting
    run = start()
    rows = until(spark, run, tmp_path / "out", 13, schema)
    run.stop()
    assert sorted((r["index"], r.url, r.error) for r in rows) == sorted([(k + 2 * (k >= 6), u, None) for k, u in enumerate(lines)] + [(7, "nope", "not an http(s) URL")])
    for host in range(3):
        own = sorted((r.started_ms, r.finished_ms, r["index"]) for r in rows if f"//h{host}." in r.url)
        assert [i for *_, i in own] == sorted(i for *_, i in own)  # those of a host in their order
        assert all(a[1] <= b[0] and a[1] - a[0] >= 150 for a, b in zip(own, own[1:], strict=False))


def test_results_live_and_versions_end_them(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "url string, result string, cached boolean"

    def start(version, days, notes=False):
        events = spark.readStream.schema("url string, result string, at timestamp").json(str(tmp_path / "in"))
        out = cached_stream(events, version, days, notes)
        return out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="50 milliseconds").start(str(tmp_path / "out"))

    def ask(name, result):
        land(tmp_path / "in", name, "".join(f'{{"url":"https://{u}","result":"{result}","at":"2024-01-01T00:00:00"}}\n' for u in "xy"))

    def answers(run, enough):
        return {(r.url, r.result, r.cached) for r in until(spark, run, tmp_path / "out", enough, schema)}

    brief = 12 / 86_400
    run = start(3, brief)
    ask("1.json", "one")
    assert answers(run, 2) == {("https://x", "one", False), ("https://y", "one", False)}
    ask("2.json", "two")
    assert ("https://x", "one", True) in answers(run, 4)
    time.sleep(13)  # past its lifetime
    ask("3.json", "three")
    assert ("https://x", "three", False) in answers(run, 6)
    run.stop()
    ask("4.json", "four")
    run = start(4, brief, notes=True)  # the same state, another version and one more column
    assert ("https://y", "four", False) in answers(run, 8)
    run.stop()


def test_bad_lines_need_no_host(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    land(tmp_path / "in", "a.txt", "\n\nnope\r\n{bad\n")
    out = stream_lines(indexed_lines(spark, str(tmp_path / "in")), F.lit(1))
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    assert sorted((r["index"], r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(2, "not an http(s) URL"), (3, "malformed JSON")]
