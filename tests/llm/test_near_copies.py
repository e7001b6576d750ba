import random

import numpy as np
import pytest

import corpus_pipeline
from pagechron.llm import near_copies
from pagechron.llm.common import merge_labels
from pagechron.llm.near_copies import components
from pagechron.llm.simhash import by_lead


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(rows):
    sets, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and similarity(sets[a], sets[b]) >= 0.8:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in up}


def families(seed=3):
    """Copies with a few words changed, about the least similarity, beside others."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(5000)]
    for size in [1] * 10 + [2] * 20 + [6] * 6 + [40]:
        base = rng.choices(vocabulary, k=300)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "too short"), (len(rows) + 3, "Too  short")]


@pytest.mark.parametrize("part_nodes", [256, 3])
def test_components_equal_brute_force(spark, part_nodes):
    rows = families()
    got = {r.doc_id: r.component_id for r in components(spark.createDataFrame(rows, "doc_id long, text string"), part_nodes).collect()}
    assert got == plain_components(rows)


def test_stage_drops_near_copies_only(spark):
    """Of a pair 0.85 alike one goes; a pair below 0.8 stays, however near its fingerprints."""
    rng = random.Random(5)
    rows = []
    for k, changes in enumerate([0, 3, 5, 5, 5, 8, 8, 20]):
        base = [f"x{rng.randrange(9999)}" for _ in range(300)]
        own = list(base)
        for c in range(changes):
            own[10 + 14 * c] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    text = dict(rows)
    assert kept == {d for d in text if d % 2 == 0 or similarity(shingles(text[d]), shingles(text[d - 1])) < 0.8}


def planted(rng, n, shared, own):
    """Pairs of sets of hashes with so many in common and so many of their own."""
    for _ in range(n):
        each = np.array([rng.getrandbits(64) for _ in range(shared + 2 * own)], dtype=np.uint64)
        yield np.unique(each[: shared + own]), np.unique(np.r_[each[:shared], each[shared + own :]])


def test_words_are_simhashes():
    """Each a majority of hashed shingles: sets 0.8 alike differ in about 0.15 of the bits, others in half."""
    rng = random.Random(4)
    sets = [a for a, _ in planted(rng, 3, 0, 40)]
    for s in [*sets, sets[0][:1], sets[0][:2]]:
        each = [near_copies.simhash(s[k : k + 1]) for k in range(len(s))]
        bits = np.array([np.unpackbits(w.view(np.uint8)) for w in each]).sum(axis=0)
        assert (np.unpackbits(near_copies.simhash(s).view(np.uint8)) == (2 * bits > len(s))).all()
    assert (near_copies.simhash(sets[0][:0]) == 0).all()
    many = np.arange(1, 10000, dtype=np.uint64)
    assert (near_copies.simhash(many) == near_copies.simhash(many[::-1])).all()
    apart = np.mean([np.bitwise_count(near_copies.simhash(a) ^ near_copies.simhash(b)).mean() for a, b in planted(rng, 100, 200, 25)])
    assert 0.13 < apart / 64 < 0.17
    assert np.bitwise_count(near_copies.simhash(sets[0]) ^ near_copies.simhash(sets[1])).mean() > 24


def test_trees_find_what_is_alike(spark):
    """Of pairs just 0.8 alike and beyond nearly all are in a bucket of the trees, others in none, however large quarters are cut."""
    rng, rows, want = random.Random(6), [], set()
    for shared, own in [(160, 20), (200, 25), (240, 20), (300, 5), (20, 2)]:
        for a, b in planted(rng, 40, shared, own):
            rows += [(len(rows), near_copies.simhash(a).view(np.int64).tolist()), (len(rows) + 1, near_copies.simhash(b).view(np.int64).tolist())]
            want.add((len(rows) - 2, len(rows) - 1))
    for a, _ in planted(rng, 200, 0, 150):
        rows.append((len(rows), near_copies.simhash(a).view(np.int64).tolist()))
    nodes = spark.createDataFrame(rows, "node long, words array<long>")
    got = near_copies._buckets(nodes).collect()
    assert all(r.n == 2 for r in got)
    found = {(r.first, r.node) for r in got if r.node != r.first}
    assert found <= want and len(found) >= 0.97 * len(want)
    assert {(r.first, r.node) for r in near_copies._buckets(nodes, 1).collect() if r.node != r.first} == found


def test_one_tree_joins_within_its_quarter_and_distance():
    """Against all pairs, with a large group of near copies, which isn't walked pair by pair."""
    rng = random.Random(8)
    base = [[rng.getrandbits(64) for _ in range(3)] for _ in range(60)]
    rows = [[w ^ sum(1 << b for b in rng.sample(range(48), rng.randrange(13))) for w in rng.choice(base)] for _ in range(500)]
    rows += [[w ^ 1 << rng.randrange(64) for w in base[0]] for _ in range(3000)]
    words = np.array(rows, dtype=np.uint64).T
    ids = np.arange(len(rows))[::-1].copy()
    got = {x: c[0] for c in (c.tolist() for c in near_copies.classes(words[0], words[1:], ids)) for x in c}
    i, j = np.triu_indices(len(rows), 1)
    apart = words[:, i] ^ words[:, j]
    bits = np.bitwise_count(apart).astype(int)
    near = (bits[0] <= near_copies.RADIUS) & (bits.sum(axis=0) <= near_copies.APART) & (apart[0] >> np.uint64(48) == 0)
    label = merge_labels(np.arange(len(rows)), ids[i[near]], ids[j[near]])
    alone = np.bincount(label, minlength=len(rows)) == 1
    assert got == {x: int(label[x]) for x in range(len(rows)) if not alone[label[x]]}
    assert max(np.bincount(label)) > 2000


def test_the_stage_goes_through_the_simhash_index(spark, monkeypatch):
    """What the tree does not join is no near copy: without it both texts of a pair stay."""
    base = [f"x{k}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[:-1], "changed"]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]
    monkeypatch.setattr(near_copies, "by_lead", lambda rows, table, node_rows: by_lead(rows.limit(0), table, node_rows))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 2]
