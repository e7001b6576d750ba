"""Benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .encoding import forget

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Windows just SIMILARITY alike differ in about 10 of 64 bits, with a deviation of about 3.
RADIUS = 15
#: A fingerprint's blocks of 16 bits.
BLOCKS = 4
#: Benchmark items that an index holds, and so are broadcast at once; more items take more passes.
ITEMS_PER_PASS = 2_000
_WORDS = re.compile(r"\w+")
_MULTIPLIER = 0x9E3779B97F4A7C15
_FIRST_BITS = 22
_GROUP_CHARS = 1 << 19
#: Windows whose sums are held at once, and of them those whose fingerprints are made at once.
_STEP = 1 << 15
_CHUNK = 1 << 11


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORDS.findall((text or "").lower())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles: shared count over joint count."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    joint = sum(a.values()) + sum(b.values()) - both
    return both / joint if joint else 0.0


def shingles(tokens: list[str]) -> Counter:
    """Multiset of the SHINGLE_WORDS-word shingles (fewer words: the whole sequence)."""
    k = SHINGLE_WORDS
    return Counter(tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))) if tokens else Counter()


_WORD_POINTS: list[np.ndarray] = []


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the text's number for every word of some texts at once."""
    if not _WORD_POINTS:
        _WORD_POINTS.append(np.fromiter((chr(p).isalnum() or p == 95 for p in range(0x110000)), dtype=bool, count=0x110000))
    lowered = [(t or "").lower() for t in texts]
    point = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = _WORD_POINTS[0][point]
    index = np.arange(len(point), dtype=np.int32)
    depth = index - np.maximum.accumulate(np.where(word, np.int32(-1), index)) - 1
    start = np.flatnonzero(word & (depth == 0))
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(depth.max()) + 1, _MULTIPLIER, dtype=np.uint64)])
    value = np.where(word, point.astype(np.uint64) + np.uint64(1), np.uint64(0)) * power[np.maximum(depth, 0)]
    h = np.add.reduceat(value, start)
    doc_start = np.cumsum([0, *(len(t) + 1 for t in lowered[:-1])])
    return h ^ (h >> np.uint64(31)), np.searchsorted(doc_start, start, side="right") - 1


def shingled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; equal runs have equal hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(_MULTIPLIER) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return out * np.uint64(_MULTIPLIER)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 bits for each hash."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(counts: np.ndarray, n: int) -> np.ndarray:
    """SimHash by bit counts over n shingles: a bit is 1 if it is set in over half of them."""
    return np.packbits((counts > n // 2).ravel(), bitorder="little").view(np.uint64)


class WindowSums:
    """Running sums of bits over shingles, for the fingerprints of all windows of any size up to ``longest`` shingles.

    Several counters share a 64-bit number. Carries between them vanish in the
    difference of two sums, as no counter of a window reaches the next one.
    """

    def __init__(self, bits: np.ndarray, longest: int):
        self.kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.int64
        each = bits.astype(self.kind, copy=False).view(np.uint64)
        self.sums = np.zeros((len(each) + 1, each.shape[1]), dtype=np.uint64)
        np.cumsum(each, axis=0, out=self.sums[1:])
        self.apart = np.empty((_CHUNK, each.shape[1]), dtype=np.uint64)
        self.over = np.empty((_CHUNK, 64), dtype=bool)

    def prints(self, n: int, windows: int) -> np.ndarray:
        """SimHashes of the first windows of n shingles."""
        out = np.empty(windows, dtype=np.uint64)
        for x in range(0, windows, _CHUNK):
            m = min(_CHUNK, windows - x)
            apart, over = self.apart[:m], self.over[:m]
            np.subtract(self.sums[x + n : x + n + m], self.sums[x : x + m], out=apart)
            np.greater(apart.view(self.kind), self.kind(n // 2), out=over)
            out[x : x + m] = np.packbits(over.ravel(), bitorder="little").view(np.uint64)
        return out


@dataclass
class SizeClass:
    """The items of one size, with the multi-index of their fingerprints."""

    size: int  #: words
    width: int  #: words of a shingle
    items: np.ndarray
    prints: np.ndarray

    @property
    def n(self) -> int:
        return self.size - self.width + 1

    @cached_property
    def near(self) -> np.ndarray:
        """[items by eights, block, value] -> packed set of the items that agree there within RADIUS // BLOCKS bits.

        Any two fingerprints within RADIUS differ in at most so many bits of some
        block. A worker makes the table once; it takes 32 kB an item.
        """
        value = np.arange(1 << 16, dtype=np.uint16)
        out = np.zeros((-(-len(self.items) // 8), BLOCKS, 1 << 16), dtype=np.uint8)
        for j, own in enumerate(self.prints.view(np.uint16).reshape(-1, BLOCKS)):
            for b in range(BLOCKS):
                out[j // 8, b] |= (np.bitwise_count(value ^ own[b]) <= RADIUS // BLOCKS).astype(np.uint8) << (j % 8)
        return out

    def listed(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each item with the places of the fingerprints that its blocks list and that lie within RADIUS."""
        blocks = np.empty((BLOCKS, len(prints)), dtype=np.intp)
        blocks[...] = prints.view(np.uint16).reshape(-1, BLOCKS).T
        for eight, near in enumerate(self.near):
            found = near[0].take(blocks[0], mode="clip")
            for b in range(1, BLOCKS):
                found |= near[b].take(blocks[b], mode="clip")
            some = np.flatnonzero(found != 0)
            some_prints = prints[some]
            for j, own in enumerate(self.prints[8 * eight : 8 * eight + 8]):  # what is within RADIUS is listed by some block
                at = np.flatnonzero(np.bitwise_count(some_prints ^ own) <= RADIUS)
                if len(at):
                    yield int(self.items[8 * eight + j]), some[at]


@dataclass
class Items:
    """Benchmark items of one pass, by size."""

    ids: list
    counts: list[Counter]
    classes: dict[int, list[SizeClass]]  #: by shingle width
    known: dict[int, tuple[np.ndarray, np.ndarray]]  #: by shingle width: the items' sorted hashes, and a table of their first bits

    @staticmethod
    def build(rows: list[tuple]) -> Items:
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in rows) if w]
        by_size: dict[int, list[int]] = {}
        for x, (_, w) in enumerate(kept):
            by_size.setdefault(len(w), []).append(x)
        classes: dict[int, list[SizeClass]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for size, members in sorted(by_size.items()):
            k = min(SHINGLE_WORDS, size)
            each = [shingled(word_hashes([" ".join(kept[x][1])])[0], k) for x in members]
            prints = np.concatenate([_prints(_bits(h).sum(axis=0, dtype=np.int64)[None, :], len(h)) for h in each])
            classes.setdefault(k, []).append(SizeClass(size, k, np.array(members, dtype=np.int64), prints))
            hashes.setdefault(k, []).extend(each)
        known = {}
        for k, each in hashes.items():
            own, table = np.unique(np.concatenate(each)), np.zeros(1 << _FIRST_BITS, dtype=bool)
            table[own >> np.uint64(64 - _FIRST_BITS)] = True
            known[k] = own, table
        return Items([i for i, _ in kept], [shingles(w) for _, w in kept], classes, known)

    def find_all(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple]]]:
        """Number and findings, (item, similarity, first word, words), of every text in which an item is found."""
        a = n = 0
        for b, t in enumerate(texts, 1):
            n += len(t or "")
            if n >= _GROUP_CHARS or b == len(texts):
                yield from ((a + x, found) for x, found in self._find(texts[a:b]))
                a, n = b, 0

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """The best window of each item found in a text."""
        return next((found for _, found in self.find_all([text])), [])

    def _find(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple]]]:
        h, doc = word_hashes(texts)
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        spans: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, classes in self.classes.items():
            s = shingled(h, k)
            if len(s):
                for item, size, starts in self._listed(s, doc, begin, classes, *self.known[k]):
                    for p in starts.tolist():
                        spans.setdefault(int(doc[p]), {}).setdefault(item, []).append((p - int(begin[doc[p]]), size))
        for x in sorted(spans):
            tokens, found = words(texts[x]), []
            for item, windows in sorted(spans[x].items()):
                best = max((similarity(self.counts[item], shingles(tokens[p : p + size])), -p, size) for p, size in windows)
                if best[0] >= SIMILARITY:
                    found.append((item, best[0], -best[1], best[2]))
            if found:
                yield x, found

    def _listed(self, s: np.ndarray, doc: np.ndarray, begin: np.ndarray, classes: list[SizeClass], own: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """item, words and starts of the windows that the index lists and that may be alike enough.

        A window that is SIMILARITY alike shares so many shingles with its item
        that a count of shingles known from any item already tells most others.
        """
        held = table[s >> np.uint64(64 - _FIRST_BITS)]
        maybe = np.flatnonzero(held)
        held[maybe] = np.isin(s[maybe], own)
        known = np.r_[0, np.cumsum(held)]
        longest, width = max(c.n for c in classes), classes[0].width
        for low in range(0, len(s), _STEP):
            sums = WindowSums(_bits(s[low : low + _STEP + longest]), longest)
            for c in classes:
                w = min(_STEP, len(s) - low - c.n + 1)
                if w <= 0:
                    continue
                for item, at in c.listed(sums.prints(c.n, w)):
                    at = at + low
                    at = at[(doc[at] == doc[at + c.size - 1]) & (known[at + c.n] - known[at] >= _least(c.n, c.n))]
                    if len(at):
                        yield item, c.size, at
        # a text with fewer words than an item is one window
        count = np.diff(begin)
        for x in np.flatnonzero((count >= width) & (count < max(c.size for c in classes))).tolist():
            a, n = int(begin[x]), int(count[x]) - width + 1
            near = [c for c in classes if c.size > count[x] and n >= SIMILARITY * c.n]
            if near and known[a + n] - known[a] >= _least(n, n):
                prints = _prints(_bits(s[a : a + n]).sum(axis=0, dtype=np.int64)[None, :], n)
                for c in near:
                    for item, _ in c.listed(prints):
                        yield item, int(count[x]), np.array([a])


def _least(a: int, b: int) -> int:
    """Shingles that two windows of a and b shingles share if they are SIMILARITY alike."""
    return math.ceil(SIMILARITY / (1 + SIMILARITY) * (a + b) - 1e-9)


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark's items, at most ITEMS_PER_PASS at a time, in the order of their ids.

    Only a pass's items are on the driver at once.
    """
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    held = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == ITEMS_PER_PASS:
            yield Items.build(held)
            held = []
    if held:
        yield Items.build(held)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id,
    similarity, first_word and n_words of the most similar window (ties: the first).

    Windows have an item's number of words (or the text's, if it has fewer). A
    window's SimHash goes to the multi-index of the items' fingerprints, which
    misses none within RADIUS bits; what it lists is verified by the weighted
    similarity of five-word shingles, SIMILARITY or more.

    Null and empty texts contain nothing; null and empty items are in nothing;
    equal items are each found; rows with a null id and repeated rows are
    reported like others; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[k], items.ids[i], s, p, n) for k, found in items.find_all(batch.column(1).to_pylist()) for i, s, p, n in found]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return find

    found = None
    for items in _passes(benchmark, item_id_col, item_text_col):
        one = rows.mapInArrow(finder(spark.sparkContext.broadcast(items)), schema)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept, nothing shuffled.

    Null and empty texts hold none; repeated rows are kept or dropped alike; an
    empty benchmark drops nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    for items in _passes(benchmark, id_col, text_col):
        shared = spark.sparkContext.broadcast(items)

        def clean_of(shared):
            @F.pandas_udf("boolean")
            def clean(texts: pd.Series) -> pd.Series:
                forget()
                held = pd.Series(True, index=range(len(texts)))
                for k, _ in shared.value.find_all([None if t is None or t != t else t for t in texts]):
                    held[k] = False
                return held

            return clean

        docs = docs.filter(clean_of(shared)(F.col(text_col)))
    return docs
