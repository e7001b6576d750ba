import random

import pytest

import numpy as np
from pagechron.llm.decontaminate import BLOCKS, RADIUS, SIMILARITY, Items, WindowSums, contaminations, shingled, shingles, similarity, without_benchmark, word_hashes, words

RNG = random.Random(11)
VOCABULARY = [f"w{k}" for k in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain(text, items):
    """The most similar window of each item's size, every window looked at."""
    tokens, out = words(text), {}
    for item, item_text in items:
        target = words(item_text)
        if not target or not tokens:
            continue
        size = min(len(target), len(tokens))
        got = max((similarity(shingles(target), shingles(tokens[p : p + size])), -p) for p in range(len(tokens) - size + 1))
        if got[0] >= SIMILARITY:
            out[item] = (got[0], -got[1])
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    return [(k, prose(rng.randrange(15, 80), rng)) for k in range(12)] + [(12, "two words"), (13, ""), (14, None)]


def edited(text, rng, n):
    tokens = text.split()
    for _ in range(n):
        tokens[rng.randrange(len(tokens))] = rng.choice(VOCABULARY)
    return " ".join(tokens)


def test_equals_brute_force(items):
    index, rng = Items.build([i for i in items if i[1] is not None]), random.Random(2)
    known = [i for i in items if i[1]]
    for k in range(120):
        item, text = known[k % len(known)]
        body = f"{prose(rng.randrange(0, 60), rng)}, {edited(text, rng, k % 4).upper()}! {prose(rng.randrange(0, 60), rng)}"
        got = {index.ids[i]: (s, p) for i, s, p, _ in index.find(body)}
        want = plain(body, known)
        assert got.keys() <= want.keys()
        assert {i: got.get(i) for i, w in want.items() if w[0] >= 0.85} == {i: w for i, w in want.items() if w[0] >= 0.85}
        assert [index.find(body)] == [f for _, f in index.find_all([body])] or not got


def test_clean_texts_and_odd_ones(items):
    index = Items.build([i for i in items if i[1] is not None])
    assert list(index.find_all([prose(500), None, "", "!!", "a b c"])) == []
    assert Items.build([]).find("a b c d e f") == []


def test_hashes_agree_across_texts():
    a, b = "one two three four five six", "x one TWO three-four five"
    h, doc = word_hashes([a, None, b])
    assert doc.tolist() == [0] * 6 + [2] * 6
    assert shingled(h, 5)[0] == shingled(h, 5)[7]
    assert len(shingled(word_hashes([a])[0], 5)) == 2
    assert len(shingled(word_hashes([""])[0], 5)) == 0


def test_the_index_lists_all_within_the_radius(items):
    """And what it lists decides: fingerprints within RADIUS, none beyond."""
    index, rng = Items.build([i for i in items if i[1]]), random.Random(3)
    for c in (c for each in index.classes.values() for c in each):
        for own, item in zip(c.prints.tolist(), c.items.tolist(), strict=True):
            prints, far = [], []
            for k in range(200):
                x, n = own, rng.randrange(0, 2 * RADIUS)
                for b in rng.sample(range(64), n):
                    x ^= 1 << b
                prints.append(x)
                far.append(n)
            got = dict(c.listed(np.array(prints, dtype=np.uint64)))
            assert got[item].tolist() == [k for k, n in enumerate(far) if n <= RADIUS]
    assert BLOCKS * (RADIUS // BLOCKS + 1) > RADIUS


@pytest.mark.parametrize(("longest", "width"), [(3, 8), (255, 8), (256, 16), (65535, 16), (65536, 64)])
def test_fingerprints_of_windows_from_shared_counters(longest, width):
    """Eight counters share a number while they fit; full ones beside empty ones carry nothing into a window's counts."""
    rng = np.random.default_rng(longest)
    bits = rng.integers(0, 2, (5000, 64), dtype=np.uint8)
    bits[1000:3000] = 1
    bits[:, 5], bits[:, 6], bits[:, 63] = 1, 0, 1
    sums = WindowSums(bits, longest)
    assert sums.sums.shape == (5001, width)
    for n in {1, 2, 3, min(longest, 254), min(longest, 255), min(longest, 4000)}:
        w = len(bits) - n + 1
        counts = np.cumsum(np.r_[np.zeros((1, 64), dtype=np.int64), bits], axis=0)
        counts = counts[n:] - counts[:-n]
        want = np.packbits((2 * counts > n).ravel(), bitorder="little").view(np.uint64)
        assert (sums.prints(n, w) == want).all() and len(want) == w
        assert len(sums.prints(n, 1)) == 1


def test_items_of_hundreds_of_words():
    rng = random.Random(12)
    long = [(k, prose(n, rng)) for k, n in enumerate([20, 259, 260, 400])]
    index = Items.build(long)
    for k, text in long:
        found = index.find(f"{prose(100, rng)} {edited(text, rng, k > 0)} {prose(100, rng)}")
        assert k in {index.ids[i] for i, *_ in found}


def test_recall_on_planted_windows(items):
    """Of items planted with edits that leave a window 0.8 alike or more, at least nine in ten are found."""
    known, rng, hit, n = [i for i in items if i[1] and len(i[1].split()) > 20], random.Random(9), 0, 0
    index = Items.build(known)
    while n < 300:
        item, text = known[rng.randrange(len(known))]
        body = f"{prose(40, rng)} {edited(text, rng, rng.randrange(0, 3))} {prose(40, rng)}"
        if item in plain(body, [(item, text)]):
            n += 1
            hit += item in {index.ids[i] for i, *_ in index.find(body)}
    assert hit >= 0.9 * n


def test_long_texts_and_shared_phrases():
    phrase = prose(12)
    index = Items.build([(k, f"{phrase} {prose(20)}") for k in range(300)])
    assert index.find(f"{prose(200)} {phrase} {prose(200)}") == []
    far = Items.build([(1, prose(30, random.Random(8)))])
    item = prose(30, random.Random(8))
    assert [f[2] for f in far.find(f"{item} {'x y z ' * 60000} {item}")] == [0]


def test_tables(spark, odd_docs, items, monkeypatch):
    monkeypatch.setattr("pagechron.llm.decontaminate.ITEMS_PER_PASS", 4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty = [(100, f"{prose(30)} {items[0][1]} {prose(30)}", "x", 1), (101, items[7][1], "x", 1), (101, items[7][1], "x", 1), (102, f"{items[3][1]} {items[9][1]}", "x", 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(dirty, odd_docs.schema))
    got = sorted((r.doc_id, r.item_id) for r in contaminations(docs, bench).collect())
    assert got == [(100, 0), (101, 7), (101, 7), (102, 3), (102, 9)]
    kept = without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == 9
    assert contaminations(docs, bench.limit(0)).collect() == []
    assert contaminations(docs.limit(0), bench).collect() == []
