import math
import random

import numpy as np
import pytest

from pagechron.llm import embed_dedup
from pagechron.llm.embed_dedup import near_vectors, pca_basis, tile_links, unit


def vectors(seed, n, d=24):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        base = rng.normal(size=d)
        out += [base + rng.normal(size=d) * s for s in rng.choice([0, 0.05, 0.2, 0.35, 1], size=rng.integers(1, 4))]
    return np.array(out, dtype=np.float32)


def plain(rows, threshold=0.95):
    ok = {k: np.array(v, dtype=float) for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {k: {j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[k] @ ok[j] / math.sqrt((ok[k] @ ok[k]) * (ok[j] @ ok[j])) >= threshold} for k in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links.get(k, ())), least, i == least or i is None))
    return sorted(out, key=str)


@pytest.mark.parametrize("d", [3, 16, 24, 40])
def test_tile_links_equal_brute_force(d):
    x, y = unit(vectors(1, 60, d)), unit(vectors(2, 60, d))
    y = np.r_[y, x[:20] + 0.001]
    y = unit(y)
    basis = pca_basis(x)
    for t in (0.5, 0.95):
        got = {(a, b) for i, j in tile_links(x, y, x @ basis, y @ basis, t, False) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {tuple(p) for p in np.argwhere(x @ y.T >= t).tolist()}
        got = {(a, b) for i, j in tile_links(x, x, x @ basis, x @ basis, t, True) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(a, b) for a, b in np.argwhere(x @ x.T >= t).tolist() if a < b}


@pytest.mark.parametrize("sparse", [-1, 0.05, 1])
def test_bounds_hold_block_by_block_and_pair_by_pair(monkeypatch, sparse):
    monkeypatch.setattr(embed_dedup, "_SPARSE", sparse)
    monkeypatch.setattr(embed_dedup, "_PAIRS", 7)
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=40) + rng.normal(size=(90, 40)) * 0.25)  # most pairs lie near 0.95
    basis = pca_basis(x)
    got = [(a, b) for i, j in tile_links(x, x, x @ basis, x @ basis, 0.95, True) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(a, b) for a, b in np.argwhere(x @ x.T >= 0.95).tolist() if a < b}
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < len(want) < 90 * 89 / 2


@pytest.mark.parametrize(("kind", "tile", "square"), [("float", 4096, 8), ("double", 16, 1), ("float", 2, 3)])
def test_table_equals_brute_force(spark, kind, tile, square):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(3, 70))]
    rows += [(500 + k, rows[0][1]) for k in range(30)]
    rows += [(600, None), (601, [0.0] * 24), (602, [float("nan")] * 24), (603, [None] + [1.0] * 23), (604, []), (605, [1.0, 0.0]), (606, [2.0, 0.0]), (None, rows[0][1]), (7, rows[7][1])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, key string")
    got = near_vectors(df, tile=tile, square=square).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == plain(rows)


def test_nothing(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), 0)
