"""Streams with state of their own: one line in flight per host, and results kept for a while."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import host_of
from .batch import CACHE_DAYS, CACHE_VERSION, parse_lines

#: What these streams need of their session: the one state store with timers, lifetimes and changes of schema.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "avro",
}
FINISHED = "host string, index long, url string, started_ms long, finished_ms long"


def use_state_store(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of file, index and value: a line's place in its file stays the same over restarts.

    A file is read whole by one task, so land lists of some megabytes each;
    ``batch.read_lines`` reads files of any size as a batch.
    """
    files = spark.readStream.text(path, wholetext=True).select("_metadata.file_path", "value")
    lines = files.select(F.col("file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("index", "value"))
    return lines.select("file", F.col("index").cast("long").alias("index"), "value")


class HostQueue(StatefulProcessor):
    """Of each host one line is in flight; the others wait in order, and each comes out when it is done.

    ``ends`` holds the numbers of the first and last line waiting and when the
    one in flight began (-1: none); ``queue`` holds the lines by number, so a
    line comes and goes at the same cost however many wait.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "first long, last long, started long")
        self.queue = handle.getMapState("queue", "number long", "index long, url string, millis long")

    def _start(self, first: int, last: int, now: int) -> None:
        """The first of those waiting sets out, if there is one."""
        if first == last:
            self.ends.update((first, last, -1))
            return
        self.ends.update((first, last, now))
        self.handle.registerTimer(now + max(1, self.queue.getValue((first,))[2]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, started = self.ends.get() if self.ends.exists() else (0, 0, -1)
        for r in sorted(rows, key=lambda r: r["index"]):
            self.queue.updateValue((last,), (r["index"], r["url"], r["millis"]))
            last += 1
        if started < 0:
            self._start(first, last, timerValues.getCurrentProcessingTimeInMs())
        else:
            self.ends.update((first, last, started))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, started = self.ends.get()
        index, url, _ = self.queue.getValue((first,))
        self.queue.removeKey((first,))
        now = timerValues.getCurrentProcessingTimeInMs()
        self._start(first + 1, last, now)
        yield Row(host=key[0], index=index, url=url, started_ms=started, finished_ms=now)

    def close(self) -> None:
        pass


def one_in_flight(lines: DataFrame, millis: Column | int = 0) -> DataFrame:
    """A stream of (index, url) to host, index, url, started_ms and finished_ms, in the order of completion.

    ``millis`` is how long a line holds its host: what its fetch took, or how long
    to be polite. No two lines of a host overlap; hosts don't wait for each other.
    A restart from the checkpoint goes on with the lines still waiting.
    """
    held = F.lit(millis) if isinstance(millis, int) else millis
    rows = lines.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "index", "url", held.cast("long").alias("millis"))
    return rows.groupBy("host").transformWithState(HostQueue(), FINISHED, "Append", "ProcessingTime")


def stream_lines(lines: DataFrame, millis: Column | int = 0) -> DataFrame:
    """A stream of (index, value) to index, url, error, started_ms and finished_ms: good lines one at a time per host, bad ones at once."""
    parsed = parse_lines(lines)
    sent = one_in_flight(parsed.filter("ok").select("index", "url"), millis)
    good = sent.select("index", "url", F.lit(None).cast("string").alias("error"), "started_ms", "finished_ms")
    none = F.lit(None).cast("long")
    return good.unionByName(parsed.filter("NOT ok").select("index", F.col("input").alias("url"), "error", none.alias("started_ms"), none.alias("finished_ms")))


class KeptResults(StatefulProcessor):
    """A URL's result answers until its lifetime in the state store ends or the version moves on."""

    def __init__(self, version: int, days: float, notes: bool = False):
        self.version, self.millis, self.notes = version, int(days * 86_400_000), notes

    def init(self, handle: StatefulProcessorHandle) -> None:
        # version 2 of the state: a note more; the store reads what version 1 has left
        self.kept = handle.getValueState("kept", "result string, version int" + ", note string" * self.notes, ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.kept.get() if self.kept.exists() else None
        if held is not None and held[1] != self.version:
            held = None
        for r in sorted(rows, key=lambda r: r["at"]):
            known = held is not None
            if not known:
                held = (r["result"], self.version, *([f"{r['at']}"] * self.notes))
                self.kept.update(held)
            yield Row(url=key[0], result=held[0], cached=known)

    def close(self) -> None:
        pass


def cached_stream(events: DataFrame, version: int = CACHE_VERSION, days: float = CACHE_DAYS, notes: bool = False) -> DataFrame:
    """A stream of (url, result, at) to url, result and cached: the first result of a URL answers for its lifetime.

    Lifetimes are the state store's own, so expired results leave it without a
    timer each; a result of another version never answers. ``notes`` keeps the
    time beside each result: a checkpoint made without them can be gone on with.
    """
    return events.groupBy("url").transformWithState(KeptResults(version, days, notes), "url string, result string, cached boolean", "Append", "ProcessingTime")
