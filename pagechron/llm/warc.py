"""WARC archives: written as records, read back, their indexes merged into one order."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bases, prepare, stage

#: Payloads below this are always written in full.
LEAST_REVISIT = 1000
#: Payload bytes in one archive file at most (but for a single larger record), so that a
#: reader's file is bounded. Records are written by classes of size, each 16 times the last.
FILE_BYTES = 1 << 30
_CLASS = 1 << 16
CRLF = "\r\n"


def _revisits(digests: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the payloads that another page repeats with a larger id."""
    kept = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return digests.join(kept, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _record() -> Column:
    """A record as text, without its last line feed, which the writer adds."""
    lines = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    payload, size = F.coalesce(F.col("html"), F.lit("")), F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    revisit = F.col("refers_to").isNotNull()
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = lines("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ", size.cast("string"), CRLF * 2)
    body = F.when(revisit, F.lit("")).otherwise(payload)
    return lines(
        "WARC/1.1", CRLF, "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"), CRLF,
        "WARC-Record-ID: <urn:page:", text(F.col("page_id")), ">", CRLF,
        "WARC-Target-URI: ", F.regexp_replace(text(F.col("url")), "[\r\n]+", ""), CRLF,
        "WARC-Date: ", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), CRLF,
        "WARC-Payload-Digest: sha1:", F.col("digest"), CRLF,
        F.when(revisit, lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", CRLF, "WARC-Refers-To: <urn:page:", text(F.col("refers_to")), ">", CRLF)).otherwise(""),
        "Content-Type: application/http; msgtype=response", CRLF,
        "Content-Length: ", (F.octet_length(head) + F.octet_length(body)).cast("string"), CRLF * 2,
        head, body, "\r\n\r",
    )


def write_warc(pages: DataFrame, path: str, captured_at: Column | None = None) -> None:
    """Write a WARC/1.1 record for every row of (page_id, url, html) under ``path``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least
    LEAST_REVISIT bytes the row with the largest page_id is the response and the
    others revisit it; a revisit's block is the HTTP head, whose Content-Length is
    the full payload's. Rows that share the largest id are all responses; rows
    with null ids always are. A page_id that comes with several payloads has a
    record for each. Capture times default to one second per page_id after
    2024-01-01. Only ids and digests are grouped; the join with the revisits is
    broadcast while adaptive execution finds them small, else it shuffles the rows
    by id and digest. Files are gzip streams of whole records, of FILE_BYTES at
    most or one record. An empty table gives no records; other columns are ignored.
    """
    when = captured_at if captured_at is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", when.alias("captured_at"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    digests = stage(rows.filter(F.col("n") >= LEAST_REVISIT).select("page_id", "digest", "n"), "digests")
    largest, again = digests.agg(F.max("n")).first()[0] or 0, _revisits(digests)
    low, high = -1, _CLASS
    while low < largest or low < 0:
        some = rows if low < 0 and largest <= high else rows.filter((F.col("n") > low) & (F.col("n") <= high))
        out = some.join(again, ["page_id", "digest"], "left").select(_record().alias("value"))
        out.write.mode("error" if low < 0 else "append").option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", max(1, FILE_BYTES // high)).text(path)
        low, high = high, high * 16


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then port, path and query; scheme, www and fragment dropped."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower().removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = ",".join(reversed(host.split(".")))
    return labels + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, named fields and block of every record of an archive file (gzip or plain).

    Records are found by their Content-Length alone, so payloads may hold anything.
    """
    plain, source, at = bytearray(), memoryview(raw), 0
    stream = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
    base = 0

    def more() -> bool:
        nonlocal at, stream
        if at >= len(source):
            return False
        piece = source[at : at + (1 << 20)]
        at += len(piece)
        if stream is None:
            plain.extend(piece)
            return True
        plain.extend(stream.decompress(piece))
        while stream.eof and stream.unused_data:  # the next gzip member
            rest, stream = stream.unused_data, zlib.decompressobj(31)
            plain.extend(stream.decompress(rest))
        return True

    pos = 0
    while True:
        while (end := plain.find(b"\r\n\r\n", pos)) < 0 and more():
            pass
        if end < 0:
            if plain[pos:].strip():
                raise ValueError("an archive file ends inside a record")
            return
        first, *lines = plain[pos:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {base + pos}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        while len(plain) < end + 4 + size + 4 and more():
            pass
        block = bytes(plain[end + 4 : end + 4 + size])
        if plain[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at {base + pos} is cut short")
        yield base + pos, fields, block
        pos = end + 8 + size
        if pos > 1 << 22:
            base += pos
            del plain[:pos]
            pos = 0


class LoserTree:
    """Merge of k sorted runs; each inner node keeps the loser of its match."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.nodes = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) >> 1
        while node:
            held = self.nodes[node]
            if held < 0:  # its other side has not come yet
                self.nodes[node] = winner
                return
            if self._beats(held, winner):
                self.nodes[node], winner = winner, held
            node >>= 1
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.nodes[0]]) is not None:
            yield head
            leaf = self.nodes[0]
            self.heads[leaf] = next(self.runs[leaf], None)
            self._play(leaf)


_INDEX = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("record_offset", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_INDEX_SQL = "run string, url_key string, captured_at string, page_id long, record_offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ORDER = ["url_key", "captured_at", "page_id", "record_offset"]


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives: one run per file, sorted by key, time and id.

    A response's size and digest are taken from its payload as read, and must be
    those it declares; a revisit's are the full payload's, which it declares.
    """
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                run, rows = name.as_py(), []
                for offset, fields, block in records(raw.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = int(dict(x.split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:])["Content-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the record at {offset} of {run} does not hold what it declares")
                    rows.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), offset, declared, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([[run] * len(rows), *columns], _INDEX, strict=True)], schema=_INDEX)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _INDEX_SQL)


def merge_runs(index: DataFrame) -> DataFrame:
    """All runs' rows in one global order of URL key, time and id; adds ``position`` (from 0).

    Key ranges are dealt to tasks, a common URL's captures divided by time and id;
    in a task a loser tree merges the runs' sorted slices. A task holds its slice,
    whose size the range partitioning bounds.
    """
    prepare(index.sparkSession)
    index = stage(index, "capture-runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, runs = TaskContext.get().partitionId(), {}
        for batch in batches:
            for run, key, at, page, offset, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(run, []).append((key, at, page is not None, page or 0, offset, run, *rest))
        for rows in runs.values():
            if any(a > b for a, b in zip(rows, rows[1:], strict=False)):
                rows.sort()  # blocks of one run may come in any order
        held, local = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            arrays = [pa.array(c, t.type) for c, t in zip(columns[:9], _INDEX, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[9], pa.int64()), pa.array([pid] * len(held), pa.int32())], names=[*_INDEX.names, "local", "pid"])

        for key, at, known, page, offset, run, *rest in LoserTree([runs[r] for r in sorted(runs)]):
            held.append((run, key, at, page if known else None, offset, *rest, local))
            local += 1
            if len(held) == 8192:
                yield out()
                held = []
        if held:
            yield out()

    dealt = index.repartitionByRange(*_ORDER)
    merged = stage(dealt.mapInArrow(merge, _INDEX_SQL + ", local long, pid int"), "captures")
    base = bases(merged.groupBy("pid").agg(F.count("*").alias("rows")), "pid", ["rows"])
    return merged.join(base, "pid").select(*_INDEX.names, (F.col("rows_before") + F.col("local")).alias("position"))


def capture_history(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records as globally ordered capture histories."""
    return merge_runs(read_index(spark, path))
