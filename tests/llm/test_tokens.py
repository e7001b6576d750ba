import random
import zlib

import numpy as np
import pytest

from pagechron.llm.common import scratch
from pagechron.llm.encoding import ChunkEncoder, vocabulary
from pagechron.llm.packing import SumOfSquares, pack_documents
from pagechron.llm.token_ids import pack_block, read_token_ids, unpack_block, write_token_ids

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize(("path", "keep_space"), [(WORDS, False), (BYTES, True)])
def test_encoder_equals_the_library(path, keep_space):
    enc, rng = ChunkEncoder(path, keep_space), random.Random(3)
    letters = "aB é.,;!?'s'll \n\t\x1c\x85\xa0 　 1٣中かÀJ̌Σς%%-_<|endoftext|>ſKİ́😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == [e.ids for e in want]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("pagechron.llm.encoding.CACHE_ENTRIES", 50)
    enc = ChunkEncoder(WORDS, False)
    for k in range(500):
        enc.encode(f"w{k} x{k}")
    assert len(enc.cache) <= 56


def test_block_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 1000):
        ids = rng.choice([1, 2, 70_000, 2**31, 300], size=n).astype(np.uint32) if n < 1000 else np.minimum(rng.zipf(1.3, n), 80_000).astype(np.uint32)
        ids = np.minimum(ids, 200_000)
        counts = np.array([n - n // 2, n // 2])
        docs, got_counts, got = unpack_block(pack_block([7, None], counts, ids))
        assert docs == [7, None]
        assert got_counts.tolist() == counts.tolist()
        assert (got == ids).all()
    with pytest.raises(ValueError, match="block"):
        unpack_block(b"XXXX" + bytes(40))


def expected_ids(docs, path, end):
    enc = ChunkEncoder(path, path == BYTES).tokenizer
    return {(r.doc_id, r.text): [*enc.encode(r.text or "", add_special_tokens=False).ids, end] for r in docs.collect()}


def test_files_round_trip(spark, odd_docs):
    path = scratch(spark, "test-ids")
    write_token_ids(odd_docs, path, WORDS)
    got = read_token_ids(spark, path).collect()
    want = expected_ids(odd_docs, WORDS, 2)
    assert len(got) == 9
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    crcs = sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got)
    rows = odd_docs.collect()
    assert crcs == sorted((r.doc_id or -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows for i in [want[r.doc_id, r.text]])
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_no_files_rows_from_nothing(spark, odd_docs):
    path = scratch(spark, "test-none")
    write_token_ids(odd_docs.limit(0), path, WORDS)
    assert read_token_ids(spark, path).collect() == []
    assert pack_documents(odd_docs.limit(0), BYTES).collect() == []


def test_sum_of_squares_choice():
    ss = SumOfSquares(window=10)
    ss.add(1, bytes(4 * 4))
    assert ss.level[4] == 1
    ss.add(2, bytes(4 * 6))  # closes the window at 4
    assert ss.n_open == 0
    assert [o[:3] for o in ss.out] == [(1, 0, 4), (2, 0, 6)]
    ss.add(3, bytes(4 * 4))
    ss.add(4, bytes(4 * 4))  # a second window at 4 would cost 3; going to 8 costs 0
    assert (ss.level[4], ss.level[8]) == (0, 1)


@pytest.mark.parametrize("sizes", ["same", "mixed", "long"])
def test_nothing_is_padded_or_lost(sizes):
    rng, ss = random.Random(5), SumOfSquares(window=64)
    docs = [[rng.randrange(1000) for _ in range({"same": 40, "mixed": rng.randrange(1, 64), "long": rng.randrange(1, 400)}[sizes])] for _ in range(500)]
    for k, ids in enumerate(docs):
        ss.add(k, np.array(ids, "<u4").tobytes())
    ss.finish()
    back, fill = {k: [None] * len(d) for k, d in enumerate(docs)}, {}
    for doc, start, n, crc, total, seq, at, ids in ss.out:
        assert total == len(docs[doc])
        assert zlib.crc32(ids) == crc
        back[doc][start : start + n] = np.frombuffer(ids, "<u4").tolist()
        fill.setdefault(seq, []).append((at, n))
    assert [back[k] for k in range(len(docs))] == docs
    for pieces in fill.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] == 64 or ends[-1] & (ends[-1] - 1) == 0


def test_every_placement_is_the_best():
    """Against plain sums of squares over all fills, with as many windows open as come; most ids stay where the rule put them."""
    rng, ss, total = random.Random(8), SumOfSquares(window=32), 0
    for k in range(3000):
        s = rng.randrange(1, 32)
        before = ss.level.copy()
        ss.add(k, bytes(4 * s))
        total += s

        def after(fill, s=s, before=before):
            level = before.copy()
            if fill:
                level[fill] -= 1
            if fill + s < 32:
                level[fill + s] += 1
            return int((level * level).sum())

        fills = [0, *(f for f in np.flatnonzero(before).tolist() if f + s <= 32)]
        assert int((ss.level * ss.level).sum()) == min(map(after, fills))
    assert ss.held == 4 * sum(f * n for f, n in enumerate(ss.level.tolist()))
    ss.finish()
    assert ss.moved < 0.05 * total
    assert sum(o[2] for o in ss.out) == total


def test_a_full_run_is_closed_and_goes_on(odd_docs, monkeypatch):
    monkeypatch.setattr("pagechron.llm.packing.RUN_BYTES", 100)
    rows = pack_documents(odd_docs, BYTES).collect()
    want = expected_ids(odd_docs, BYTES, 1)
    assert sum(r.length for r in rows) == sum(len(want[r.doc_id, r.text]) for r in odd_docs.collect())


def test_pack_table(odd_docs):
    rows = pack_documents(odd_docs, BYTES, with_ids=True).collect()
    want = expected_ids(odd_docs, BYTES, 1)
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, {}).setdefault(r.start, []).append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    for (doc_id, _), ids in want.items():
        copies = len(docs[doc_id][0])
        assert sum(len(x) for p in docs[doc_id].values() for x in p) == copies * len(ids)
    assert {r.sequence_id for r in rows} == set(range(max(r.sequence_id for r in rows) + 1))
