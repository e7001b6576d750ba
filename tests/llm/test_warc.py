import gzip
import hashlib
import random

import pytest

from pagechron.llm import warc
from pagechron.llm.common import scratch
from pagechron.llm.warc import LoserTree, capture_history, records, url_key, write_warc

BIG = "<p>é</p>" * 200


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(40), rng.randrange(3)) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
    assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(
    ("url", "key"),
    [("http://www.Example.org/A?b=1#f", "org,example)/a?b=1"), ("https://a.b.org:8080", "org,b,a:8080)/"), ("https://a.org:443/x", "org,a)/x"), ("", ""), ("no url", "no url"), ("http://[bad", "http://[bad")],
)
def test_url_key(url, key):
    assert url_key(url) == key


def record(payload):
    return b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)


def test_records_are_found_by_length():
    payloads = [b"", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"x" * 3_000_000, b"\r\n\r\n\r\n"]
    plain = b"".join(map(record, payloads))
    members = b"".join(gzip.compress(record(p)) for p in payloads)
    for raw in (plain, gzip.compress(plain), members):
        got = list(records(raw))
        assert [b for *_, b in got] == payloads
        assert [o for o, *_ in got] == [sum(len(record(p)) for p in payloads[:k]) for k in range(4)]
    with pytest.raises(ValueError, match="short|inside"):
        list(records(plain[:-6]))


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://a.org/x", BIG), (2, "http://b.org/", BIG), (3, "http://a.org/x", BIG), (4, "http://c.org/", "small"), (5, "http://c.org/", "small"), (6, None, None), (7, "http://d.org/\r\nX: y", ""),
        (None, "http://n.org/", BIG), (8, "http://a.org/b", "WARC/1.1\r\n\r\n" * 300), (8, "http://a.org/b", "WARC/1.1\r\n\r\n" * 300),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")


def test_round_trip(spark, pages):
    path = scratch(spark, "test-warc")
    write_warc(pages, path)
    rows = capture_history(spark, path).collect()
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert sorted(r.page_id or -1 for r in rows) == sorted(r.page_id or -1 for r in pages.collect())
    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(want[r.page_id]), hashlib.sha1(want[r.page_id]).hexdigest())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None), 8: ("response", None)}
    order = [(r.url_key, r.captured_at) for r in sorted(rows, key=lambda r: r.position)]
    assert order == sorted(order)
    assert sorted(r.position for r in rows) == list(range(len(rows)))


def test_recrawled_page(spark):
    """One id with several payloads: each has its record, and none is lost."""
    df = spark.createDataFrame([(1, "http://a.org/", BIG), (1, "http://a.org/", BIG + "x"), (2, "http://b.org/", BIG), (None, None, BIG + "x")], "page_id long, url string, html string")
    path = scratch(spark, "test-warc-again")
    write_warc(df, path)
    got = sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in capture_history(spark, path).collect())
    one, two = (hashlib.sha1(x.encode()).hexdigest() for x in (BIG, BIG + "x"))
    assert got == sorted([(0, two, "response", None), (1, one, "revisit", 2), (1, two, "response", None), (2, one, "response", None)])


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4096)
    monkeypatch.setattr(warc, "_CLASS", 1024)
    rows = [(k, f"http://a.org/{k}", chr(97 + k % 26) * n) for k, n in enumerate([0, 10, 900, 1024, 1025, 1500, 3000, 5000, 16384, 16385, 90000] * 3)]
    path = scratch(spark, "test-warc-large")
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = capture_history(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(k, len(h)) for k, _, h in rows]
    held = {}
    for r in got:
        held.setdefault(r.run, []).append(r.payload_bytes)
    assert all(len(sizes) == 1 or sum(sizes) <= 4096 for sizes in held.values())


def test_nothing(spark, pages):
    path = scratch(spark, "test-warc-none")
    write_warc(pages.limit(0), path)
    assert capture_history(spark, path).collect() == []
