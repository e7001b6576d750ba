import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from pagechron.llm import quality
from pagechron.llm.common import read
from pagechron.llm.quality import _Hashes, dual_coordinate_descent, fit, ngrams, score_quality, sigmoid_line

DATA = Path("/root/testdata/sf0.01")
TEXTS = ["The the the CAT 12_cat!! ...\n\nA a", "", None, "x", "日本 日本 Ünï ünï\nÜNÏ a1b2 ,., .", "one two\x1cthree"]


def shape(token):
    if token[0].isalpha():
        return 1 if token.islower() else 3 if token.isupper() and len(token) > 1 else 2 if token.istitle() else 4 if token.lower() != token.upper() else 5
    return {"\n": 6, ".": 7, ",": 8}.get(token) or (9 if token[0].isdecimal() else 10 if len(token) == 1 else 11)


def plain(text):
    """Kinds of n-grams of a text, spelled out."""
    t = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n", text or "")
    s = [15 if k and t[k - 1] == x else shape(x) for k, x in enumerate(t)]
    return {("token", x) for x in t} | {("pair", *t[k : k + 2]) for k in range(len(t) - 1)} | {("shape", *s[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}


@pytest.mark.parametrize("window", [1, 2, 5, 1 << 18])
@pytest.mark.parametrize("long_from", [1, 1 << 19])
def test_ngrams_are_those_spelled_out(monkeypatch, window, long_from):
    monkeypatch.setattr(quality, "_TOKENS", window)
    monkeypatch.setattr(quality, "_CHARS", long_from)
    got = {}
    for doc, key in ngrams(TEXTS, _Hashes()):
        for d, k in zip(doc.tolist(), key.tolist(), strict=True):
            got.setdefault(d, set()).add(k)
    for d, t in enumerate(TEXTS):
        assert len(got.get(d, ())) == len(plain(t)), t
    everything = set().union(*(plain(t) for t in TEXTS))
    assert len(set().union(*got.values())) == len(everything)


def test_descent_finds_the_least_loss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.6)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=40) > 0, 1.0, -1.0)
    at = [np.flatnonzero(r) for r in x]
    start = np.cumsum([0, *map(len, at)])
    w, b = dual_coordinate_descent(start, np.concatenate(at), np.concatenate([r[k] for r, k in zip(x, at, strict=True)]), y, 6, rounds=5000, tolerance=1e-10)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()
    best = np.r_[w, b]
    for _ in range(3000):
        assert loss(best) <= loss(best + rng.normal(size=7) * 10.0 ** rng.uniform(-6, 0)) + 1e-7


def test_line_orders_and_centres():
    rng = np.random.default_rng(6)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * (x - 0.4)))).astype(float)
    threshold, scale = sigmoid_line(x, y)
    assert abs(threshold - 0.4) < 0.1 and abs(scale - 3) < 0.4
    assert sigmoid_line(-x, y)[1] > 0  # never turned round


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_rows(spark):
    docs, labels = read(spark, str(DATA), "documents"), read(spark, str(DATA), "labels")
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) >= 0.95
    kept = [p for p, q in held if q == 1]
    assert sum(kept) / len(kept) >= 0.98


def test_held_out_labels_teach_nothing(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = fit(docs, labels), fit(docs, turned)
    assert (a.weight == b.weight).all() and (a.threshold, a.scale, a.bias) == (b.threshold, b.scale, b.bias)


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)] + [(3, None), (None, 1), (77, 1), (5, 0), (5, 1)], "doc_id long, quality int")
    got = score_quality(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    by_text = {r.doc_id: r.score for r in got}
    assert by_text[3] == by_text[4]  # no n-grams, no difference
    empty = labels.limit(0)
    assert {r.score for r in score_quality(odd_docs, empty).collect()} == {0.0}
    assert score_quality(odd_docs.limit(0), labels).collect() == []
