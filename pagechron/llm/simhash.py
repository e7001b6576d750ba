"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_labels, prepare, stage, star_components, without

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints alike in a leading quarter that one part has at most.
NODE_ROWS = 200_000
#: What a node of the tree holds.
_FANOUT = 4
_PAIRS = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """SimHash of the text's k-word shingles, repeats included.

    A-Z is lower-cased, words are runs of anything but space and \\t to \\r; with
    fewer than k words the whole sequence is the one shingle, with none the
    fingerprint is 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - k + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    prepare(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each pattern in the sequence of Gray codes."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """One tree over patterns in Gray order; a node keeps the bits that all below it share.

    Neighbours in Gray order differ in few bits, most of them late ones, so a node
    shares about as many leading bits as there are halvings down to it, and others
    by chance. ``mask[l][x]`` marks the bits shared under node x of level l and
    ``bits[l][x]`` holds them. Two nodes are dropped with everything below them once
    the differences in the bits that both share, which only grow on the way down,
    exceed the radius, or touch the ``lead``, bits in which pairs may not differ.
    ``met`` and ``dropped`` count pairs of nodes, ``compared`` pairs of patterns.
    ``more`` has rows of further words of each pattern, which count in ``link`` alone.
    """

    def __init__(self, fp: np.ndarray, lead: int = 0, more: np.ndarray | None = None):
        self.fp, self.lead, self.more = fp, np.uint64(lead), more
        self.low: list[np.ndarray] | None = None
        self.mask, self.bits, self.starts = [], [], []
        self.met = self.dropped = self.compared = 0
        both, any_, n = fp, fp, len(fp)
        while True:
            cuts = np.arange(0, n, _FANOUT)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            self.mask.append(~(both ^ any_))
            self.bits.append(both)
            self.starts.append(np.r_[cuts, n])
            n = len(cuts)
            if n == 1:
                break

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs x <= y of what lies directly under a[i] and b[i]."""
        at, starts = np.arange(_FANOUT), self.starts[level]
        x = np.repeat(starts[a][:, None] + at, _FANOUT, axis=1).ravel()
        y = np.tile(starts[b][:, None] + at, (1, _FANOUT)).ravel()
        ok = (x < np.repeat(starts[a + 1], _FANOUT**2)) & (y < np.repeat(starts[b + 1], _FANOUT**2)) & (x <= y)
        return x[ok], y[ok]

    def _near(self, level: int, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        m, p = self.mask[level], self.bits[level]
        apart = (p[a] ^ p[b]) & m[a] & m[b]
        near = (np.bitwise_count(apart) <= radius) & ((apart & self.lead) == 0)
        if self.low is not None:
            low, high = self.low[level], self.high[level]
            near &= (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        self.met += len(near)
        self.dropped += len(near) - int(near.sum())
        return near

    def _classes(self, label: np.ndarray) -> None:
        """Least and largest label under each node; pairs of nodes all of one class are dropped from now on."""
        self.low, self.high, low, high = [], [], label, label
        for starts in self.starts:
            low, high = np.minimum.reduceat(low, starts[:-1]), np.maximum.reduceat(high, starts[:-1])
            self.low.append(low)
            self.high.append(high)

    def leaf_pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (a <= b) that may hold patterns within the radius, from the root down, in bounded pieces."""
        root = np.zeros(1, dtype=np.int64)
        stack = [(len(self.mask) - 1, root, root)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 4096 and level:
                stack += [(level, a[k : k + 4096], b[k : k + 4096]) for k in range(0, len(a), 4096)]
                continue
            if not level:
                yield a, b
                continue
            x, y = self._below(level, a, b)
            ok = self._near(level - 1, x, y, radius)
            if ok.any():
                stack.append((level - 1, x[ok], y[ok]))

    def link(self, label: np.ndarray, radius: int, joint: int | None = None) -> np.ndarray:
        """Join the classes of all patterns within the radius; leaves of one class aren't compared.

        With ``joint`` at most so many bits may differ in the pattern and all its
        further words, and nodes of one class aren't walked either, as wide radii
        let large groups meet everywhere.
        """
        held, many = [], 0
        first = self.starts[0][:-1]
        leaves = len(first)

        def work(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
            low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            todo = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            x, y = self._below(0, a[todo], b[todo])
            apart = self.fp[x] ^ self.fp[y]
            ok = (x < y) & (np.bitwise_count(apart) <= radius)
            self.compared += int((x < y).sum())
            if joint is not None:
                ok &= (apart & self.lead) == 0
            x, y, apart = x[ok], y[ok], apart[ok]
            if joint is not None:
                bits = sum((np.bitwise_count(w[x] ^ w[y]) for w in self.more), np.bitwise_count(apart).astype(np.int64))
                x, y = x[bits <= joint], y[bits <= joint]
            label = merge_labels(label, x, y)
            if self.low is not None:
                self._classes(label)
            return label

        own = np.arange(leaves)
        for k in range(0, leaves, _PAIRS):  # leaves by themselves first: most classes close here
            label = work(own[k : k + _PAIRS], own[k : k + _PAIRS], label)
        if joint is not None:
            for k in range(0, leaves - 1, _PAIRS):
                label = work(own[:-1][k : k + _PAIRS], own[1:][k : k + _PAIRS], label)
            self._classes(label)
        for a, b in self.leaf_pairs(radius):
            held.append((a[a != b], b[a != b]))
            many += len(held[-1][0])
            if many >= _PAIRS:
                label = work(*map(np.concatenate, zip(*held, strict=True)), label)
                held, many = [], 0
        if many:
            label = work(*map(np.concatenate, zip(*held, strict=True)), label)
        return label


#: The leading quarter of a rotated fingerprint: pairs that differ there are found in another rotation.
LEAD = 0xFFFF << 48


def rotation(column: str, quarter: int) -> str:
    """SQL for a long turned left by so many quarters."""
    return f"({column} << {16 * quarter}) | shiftrightunsigned({column}, {64 - 16 * quarter})" if quarter else column


def links_of(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the classes of all fingerprints of one rotation that are alike in its leading quarter and within the radius."""
    fp = np.unique(fp)
    if len(fp) < 2:
        return fp[:0], fp[:0]
    fp = fp[np.argsort(gray_rank(fp))]
    label = GrayIndex(fp, LEAD).link(np.arange(len(fp)), radius)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def by_lead(rows: DataFrame, table: str, node_rows: int) -> DataFrame:
    """Rows of turned fingerprints, those of one table and leading quarter together: node, i, j and their columns.

    A quarter with over ``node_rows`` fingerprints is cut into parts by a hash, and
    every two parts, i and j, meet in a task; no pair is lost.
    """
    columns = rows.columns
    rows = rows.withColumn("node", F.expr(f"{table} * 65536L + shiftrightunsigned(turned, 48)"))
    # at most so many nodes are large as there are rows by node_rows
    large = rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > node_rows).select("node", F.ceil(F.col("n") / node_rows).alias("parts"))
    rows = rows.join(stage(large, "large-nodes"), "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("turned"), F.col("parts"))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), *columns)
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of a task of ``by_lead`` as columns of longs, some hundred thousand at a time and each node's together."""
    held: list[np.ndarray] = []
    have = 0
    for batch in batches:
        held.append(np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns]))
        have += batch.num_rows
        if have >= 1 << 17:
            rows = np.concatenate(held, axis=1)
            end = int(np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])[-1])
            yield rows[:, :end]
            held, have = [rows[:, end:]], rows.shape[1] - end
    if held:
        yield np.concatenate(held, axis=1)


def near_links(unique: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(u, v) links whose components are those of all pairs within the radius.

    In each of four rotations a fingerprint goes to a task by its leading quarter,
    so any two within 3 bits meet in some rotation. A task builds one Gray-ordered
    tree over all its fingerprints of a rotation, some hundred thousand at a time
    and those of one quarter together, and walks it from the root against itself.
    A tree gives one link less than a class has members.
    """
    if radius > 3:
        raise ValueError("four quarters guarantee pairs within 3 bits")
    prepare(unique.sparkSession)
    quarters = F.posexplode(F.array(*(F.expr(rotation("fp", k)) for k in range(4)))).alias("quarter", "turned")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_nodes(batches):
            for quarter in np.unique(rows[3]).tolist():
                links = links_of(rows[4][rows[3] == quarter].view(np.uint64), radius)
                k = np.uint64(16 * quarter)
                u, v = ((((x >> k) | (x << (np.uint64(64) - k))) if quarter else x).view(np.int64) for x in links)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return by_lead(unique.select(quarters), "quarter", node_rows).mapInArrow(search, "u long, v long")


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) to doc_id, fp and component_id, the smallest id reachable by links.

    Equal fingerprints are one node however many documents have them; ids that
    are null never name a component.
    """
    unique = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = star_components(near_links(unique, radius))
    nodes = unique.join(roots, unique.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts have fingerprint 0 and link like any other; repeated
    rows repeat; an empty table gives no rows; other columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "prints")
    return components(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component, all columns kept.

    Repeated rows of that id stay; rows with a null id can't be told apart and
    stay or go together: they stay if any of them is in a component of which no
    id is known.
    """
    groups = components(stage(fingerprints(docs, id_col, text_col), "prints"), radius)
    return without(docs, groups, id_col)
