import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from xxhash import xxh64_intdigest

from pagechron.llm.common import merge_labels, star_components
from pagechron.llm.simhash import LEAD, GrayIndex, components, fingerprint, gray_rank, links_of, near_duplicates, one_of_each


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, radius=3):
    up = {fp: fp for _, fp in pairs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    prints = sorted(up)
    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= radius:
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for d, fp in pairs:
        if d is not None:
            least[top(fp)] = min(d, least.get(top(fp), d))
    return {(d, fp): least.get(top(fp)) for d, fp in pairs}


def families(rng, n, spread=4):
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            x = base
            for _ in range(rng.randrange(spread)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


@pytest.mark.parametrize("text", ["", None, "a", "A b", "one two three", "İstanbul ÀB cd ef gh", "x " * 500, "one two three\tfour\vfive"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [3, 60, 900])
def test_gray_index_loses_no_pair(n):
    fp = np.unique(np.array(families(random.Random(n), n), dtype=np.uint64))
    fp = fp[np.argsort(gray_rank(fp))]
    i, j = np.triu_indices(len(fp), 1)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 3
    assert (GrayIndex(fp).link(np.arange(len(fp)), 3) == merge_labels(np.arange(len(fp)), i[near], j[near])).all()


def turned(fp, quarter):
    k = np.uint64(16 * quarter)
    return (fp << k) | (fp >> (np.uint64(64) - k)) if quarter else fp


def test_the_tree_drops_whole_groups():
    """Over all fingerprints of a table: several levels, most pairs of nodes dropped, few patterns compared, no pair lost."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    fp = np.unique(np.array([fingerprint(t) for t in table.column("text").to_pylist()], dtype=np.uint64))
    i, j = np.triu_indices(len(fp), 1)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 3
    label = np.arange(len(fp))
    for quarter in range(4):
        now = turned(fp, quarter)
        order = np.argsort(gray_rank(now))
        index = GrayIndex(now[order], LEAD)
        own = index.link(np.arange(len(fp)), 3)
        assert len(index.mask) >= 4
        assert index.dropped > index.met / 2 > 0
        assert index.compared < len(i) / 20  # what is left to compare, of all pairs
        label = merge_labels(label, order, order[own])
    assert (label == merge_labels(np.arange(len(fp)), i[near], j[near])).all()


@pytest.mark.parametrize("bits", [12, 64])
def test_four_rotations_join_what_all_pairs_join(bits):
    rng = random.Random(bits)
    fp = np.array([rng.getrandbits(bits) << (3 * (n % 4)) & (1 << 64) - 1 for n in range(500)] + families(rng, 100), dtype=np.uint64)
    each = np.unique(fp)
    label = np.arange(len(each))
    for quarter in range(4):
        u, v = (turned(x, (4 - quarter) % 4) for x in links_of(turned(fp, quarter)))
        assert (np.bitwise_count(u ^ v) > 0).all()
        label = merge_labels(label, np.searchsorted(each, u), np.searchsorted(each, v))
    i, j = np.triu_indices(len(each), 1)
    near = np.bitwise_count(each[i] ^ each[j]) <= 3
    assert (label == merge_labels(np.arange(len(each)), i[near], j[near])).all()
    assert len(links_of(fp[:1])[0]) == len(links_of(fp[:0])[0]) == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("node_rows", [200_000, 3])
def test_components(spark, monkeypatch, node_rows):
    """Also with every top node of the index cut into parts."""
    monkeypatch.setattr("pagechron.llm.simhash.NODE_ROWS", node_rows)
    monkeypatch.setattr("pagechron.llm.simhash.near_links.__defaults__", (3, node_rows))
    rng = random.Random(7)
    prints = [*families(rng, 80), *families(rng, 3, 6) * 2, 0, 0, 1, *[rng.getrandbits(3) for _ in range(20)]]
    pairs = [(k if k % 17 else None, fp) for k, fp in enumerate(prints)]
    rows = components(spark.createDataFrame([(d, signed(fp)) for d, fp in pairs], "doc_id long, fp long")).collect()
    want = plain_components(pairs)
    assert len(rows) == len(pairs)
    assert all(r.component_id == want[r.doc_id, r.fp % (1 << 64)] for r in rows)


def test_star_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(-5, 200), (200, -5), (7, 7)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(2, 61)} == {1}
    assert {got[k] for k in range(101, 140)} == {100}
    assert got[200] == -5
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (3, 4, 8)} == {("0" * 16, 3)}
    kept = sorted(r.doc_id or -1 for r in one_of_each(odd_docs).collect())
    assert kept == [1, 3, 5, 7] or kept == [-1, 1, 3, 5, 7]
    assert set(one_of_each(odd_docs).columns) == set(odd_docs.columns)
    assert near_duplicates(odd_docs.limit(0)).collect() == []
