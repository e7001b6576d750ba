import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pagechron.llm.source_audit import Resident, audit_sources, packed, visits

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top=10):
    """(lang, source, part, item, value, rank) straight from the definition; rows of lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    out = set()
    for lang in {r[0] for r in rows}:
        own = [(s, words(t)) for la, s, t in rows if la == lang]
        in_docs = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in in_docs.items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        count = lambda keep: Counter(t for s, w in own if keep(s) for t in w if t in kept)
        sources = {s for s, _ in own}
        counts = {s: count(lambda x, s=s: x == s) for s in sources}
        p, q = {s: share(c) for s, c in counts.items()}, share(count(lambda _: True))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)}
    return out


ROWS = [
    ("en", "a", "The cat sat; the CAT ran. İzmir ÉTÉ été"), ("en", "a", "the dog's dog"), ("en", "b", "a cat, a dog & a bird été"), ("en", "b", "the end"),
    ("en", "c", ""), ("en", "c", None), ("en", None, "bird bird bird the the 7"), ("en", "d", "cat " * 400_000 + "zebra"), ("en", "d", "zebra"),
    (None, "a", "only one source"), ("", "a", "only two"), ("xx", "p", "unique words"), ("xx", "q", "other things"), ("xx", "q", "other things"),
]


@pytest.mark.parametrize(("least", "block_groups", "shard_terms"), [(1, 8, 1 << 15), (2, 1, 3), (3, 2, 1)])
def test_equals_the_definition(spark, least, block_groups, shard_terms):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS rank", "3 AS shard")
    got = audit_sources(docs, least_documents=least, block_groups=block_groups, shard_terms=shard_terms).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain(ROWS, least)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert audit_sources(empty).collect() == []


def test_counts_beyond_a_long_times_the_unit(spark):
    from pagechron.llm.source_audit import _share

    n, total, terms = 9_000_000_000_000, 9_000_000_000_123, 77
    row = spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS total", f"{terms}L AS terms").select(_share("n", "total", "terms").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * terms)


@pytest.mark.parametrize("blocks", [1, 2, 5, 8, 9])
def test_rotation_is_a_round_robin(spark, blocks):
    rows = visits(spark.range(blocks).selectExpr("id AS block", f"{blocks}L AS blocks")).collect()
    assert sorted(r.block for r in rows if r.round < 0) == list(range(blocks))
    met = [(r["round"], *sorted((r.block, r.home))) for r in rows if r.round >= 0]
    assert sorted(m[1:] for m in met) == sorted(combinations(range(blocks), 2))
    busy = [(r, b) for r, *pair in met for b in pair]
    assert len(busy) == len(set(busy))  # nobody is in two meetings of one round
    home = Counter(r.home for r in rows if r.round >= 0)
    assert max(home.values(), default=0) <= blocks // 2 + 1


def test_a_meeting_counts_every_term_once():
    rng = np.random.default_rng(7)
    for _ in range(50):
        width = int(rng.integers(1, 40))
        make = lambda w=width: (np.flatnonzero(rng.random(w) < rng.random()), int(rng.integers(1, 1000)))
        (i, a), (j, b) = make(), make()
        p, q = rng.integers(1, 10**9, len(i)), rng.integers(1, 10**9, len(j))
        steps, shares = packed(i, p)
        full = [np.full(width, a), np.full(width, b)]
        full[0][i], full[1][j] = p, q
        want = sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(*full, strict=True))
        assert Resident({"source": "s", "rest": a, "width": width, "steps": steps, "shares": shares}).meet(j, q, b) == want
