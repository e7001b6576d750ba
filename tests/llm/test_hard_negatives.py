import math
from collections import defaultdict

import numpy as np
import pytest

from pagechron.llm.hard_negatives import _Index, _whole, augmented, best, mine_negatives


def plain(rows, every=100, positives=5, negatives=10):
    """All anchors against all rows of (vec_id, vector, label), unique ids."""
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = ([math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = set()
    for a in (i for i in own if i % every == 0):
        score = {i: sum(x * y for x, y in zip(v, own[a][0], strict=False)) for i, (v, _) in own.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        same = [i for i in order if own[i][1] == own[a][1]][:positives]
        for p in same:
            near = [i for i in order if own[i][1] != own[a][1] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(near[:negatives], 1)}
    return out


def vectors(rng, n, dim, kind):
    if kind == "clusters":
        x = rng.normal(size=(5, dim))[rng.integers(0, 5, n)] + 0.1 * rng.normal(size=(n, dim))
    elif kind == "ties":
        x = rng.integers(-1, 2, size=(n, dim)) / 2
    elif kind == "lengths":
        x = rng.normal(size=(n, dim)) * rng.exponential(size=(n, 1))
    else:
        x = rng.normal(size=(n, dim))
    return [(i * (7 if kind == "ties" else 1), [float(v) for v in np.float32(r)], int(rng.integers(0, 4))) for i, r in enumerate(x)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["ties", "lengths"])
def test_equals_all_pairs(spark, kind):
    rows = vectors(np.random.default_rng(len(kind)), 400, 6, kind)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tile", "'x' AS block", "2 AS score")
    got = mine_negatives(docs, anchor_every=5, pivots=7, block=23, tile=9).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain(rows, every=5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 2), (5, [1.0, -inf], 2), (6, [0.6, 0.4], 2), (None, [1.0, 1.0], 2), (8, [0.5, 0.5], None), (100, [1.0], 3), (200, [], 3), (300, [-1.0, -1.0], 1), (9, [0.7, 0.2, 0.5], 2), (10, [0.0, 0.0], 3)]
    docs = spark.createDataFrame(rows + [(6, [0.6, 0.4], 2), (6, [9.0, 9.0], 5), (11, [3e6, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in mine_negatives(docs).collect()}
    assert got == plain(rows)
    assert mine_negatives(docs.limit(0)).collect() == []
    assert mine_negatives(docs.filter("vec_id = 8")).collect() == []
    assert mine_negatives(docs.filter("vec_id = 0")).collect() == []


def test_annuli_leave_blocks_unread(spark, monkeypatch):
    """Clustered rows: far fewer (tile, block) meetings than all, and still every row."""
    rng = np.random.default_rng(3)
    rows = vectors(rng, 3000, 8, "clusters")
    met = []
    pairs = _Index._pairs

    def counted(self, asked, first):
        out = pairs(self, asked, first)
        met.append((out.count(), self.blocks.count() * self.tiles.count()))
        return out

    monkeypatch.setattr(_Index, "_pairs", counted)
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), anchor_every=50, pivots=16, block=40, tile=4).collect()
    assert {tuple(r) for r in got} == plain(rows, every=50)
    read, possible = met[1]  # the search for positives, after each anchor's own block
    assert read < possible / 2


def test_keys_bound_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(50, 5))
    norm = (x * x).sum(axis=1)
    y = augmented(x, norm, int(norm.max()))
    assert np.allclose((y * y).sum(axis=1), norm.max())
    q = np.r_[x[0], 0.0]
    apart = ((y - q) ** 2).sum(axis=1)
    assert np.allclose(apart, norm[0] + norm.max() - 2 * (x @ x[0]))


def test_best_by_score_then_id():
    rng = np.random.default_rng(2)
    for _ in range(30):
        score, ids = rng.integers(0, 4, size=(5, 12)).astype(float), rng.permutation(12)
        score[rng.random((5, 12)) < 0.3] = -np.inf
        got = defaultdict(list)
        for i, j in zip(*best(score, ids, 4), strict=True):
            got[int(i)].append(int(j))
        for i in range(5):
            want = sorted((j for j in range(12) if score[i, j] > -np.inf), key=lambda j: (-score[i, j], ids[j]))
            assert got[i] == want[:4]


def test_whole_components(spark):
    rows = spark.createDataFrame([(7, [0.5, -0.001], 9), (8, [1 / 3, 2.0], 9)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.label, np.frombuffer(r.vec, "<i4").tolist(), r.norm) for r in _whole(rows, "vec_id", "embedding", "label").collect()}
    assert got == {7: (0, [128, -1], 128 * 128 + 1), 8: (9, [85, 512], 85 * 85 + 512 * 512)}
