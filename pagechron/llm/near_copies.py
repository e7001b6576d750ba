"""Near copies by SimHash: documents whose sets of five-word shingles are at least 0.8 alike.

Every set of shingles has a SimHash of many words. Sets that may be alike are found
by the SimHash operator's index, a Gray-ordered tree of every rotation of every word,
with a wide radius; what it finds together is then verified by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merge_labels, prepare, stage, star_components, without
from .encoding import forget
from .simhash import LEAD, NODE_ROWS, GrayIndex, by_lead, gray_rank, rotation, whole_nodes

SHINGLE_WORDS = 5
#: Least similarity, as whole numbers: shared shingles of joint shingles.
SHARED, JOINT = 4, 5
#: Words of a SimHash that have a tree in each of their four rotations. A bit of two sets just
#: 0.8 alike is the same with probability 0.848, so they share the leading quarter of none of
#: the 64 with probability (1 - 0.848 ** 16) ** 64, which is 0.008.
WORDS = 16
#: Further words, with which pairs of one leading quarter are told apart.
CHECKS = 2
#: Bits that may differ in a pattern alone, and in it and the further words: of the 48 and 176
#: that are not the same by the leading quarter, sets just 0.8 alike differ in 7 and 27 (deviations 2.5 and 4.8).
RADIUS, APART = 20, 48
#: Nodes of one bucket that meet in one task as one part.
PART_NODES = 256
SEED = 42
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 4096
_rng = np.random.default_rng(SEED)
_SALT = _rng.integers(0, 1 << 64, WORDS + CHECKS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, WORDS + CHECKS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending hashes of the text's distinct shingles; words are those of the SimHash operator.

    With fewer than five words the whole sequence is the one shingle, without any there is none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter((xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE_WORDS, len(words))
    n = len(words) - k + 1 if k else 0
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + h[i : i + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * _MULTIPLIER)


def node_of(shingles: np.ndarray) -> int:
    """One signed number for all texts with these shingles."""
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest(shingles.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def simhash(shingles: np.ndarray) -> np.ndarray:
    """WORDS + CHECKS words, each the SimHash by a hash of its own: a bit is 1 if it is set for over half of the shingles."""
    ones = np.zeros(64 * len(_SALT), dtype=np.int64)
    for at in range(0, len(shingles), _PIECE):
        mixed = shingles[at : at + _PIECE, None] ^ _SALT
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MULTIPLIER
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).ravel(), bitorder="little").reshape(len(mixed), -1)
        for k in range(0, len(bits), 255):  # as many as a byte counts
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def alike(a: Column, b: Column) -> Column:
    """Are two sets of shingles alike?"""
    both = F.size(F.array_intersect(a, b))
    joint = F.size(a) + F.size(b) - both
    return (F.least(F.size(a), F.size(b)) * JOINT >= F.greatest(F.size(a), F.size(b)) * SHARED) & (both * JOINT >= joint * SHARED)


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, node and SimHash of (doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            words = np.concatenate([simhash(s) for s in sets]) if sets else np.zeros(0, dtype=np.uint64)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (WORDS + CHECKS)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), each], names=["doc_id", "node", "words"])

    return docs.mapInArrow(compute, "doc_id long, node long, words array<long>")


def classes(turned: np.ndarray, more: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """The ids, ascending, of each class of two or more that one tree joins: of a leading quarter and within RADIUS and APART."""
    order = np.argsort(gray_rank(turned))
    ids = ids[order]
    label = GrayIndex(turned[order], LEAD, more[:, order]).link(np.arange(len(order)), RADIUS, APART)
    several = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    several = several[np.argsort(label[several], kind="stable")]
    for members in np.split(several, np.flatnonzero(np.diff(label[several])) + 1) if len(several) else []:
        members = np.unique(ids[members])
        if len(members) > 1:
            yield members


def _buckets(nodes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """bucket, node, n and first of (node, words): the classes of all trees, equal ones once, with their size and least node."""
    from xxhash import xxh64_intdigest

    checks = [F.element_at("words", WORDS + 1 + k).alias(f"check{k}") for k in range(CHECKS)]
    each = nodes.select(F.col("node").alias("id"), *checks, F.posexplode(F.slice("words", 1, WORDS)).alias("at", "word"))
    turns = F.array(*(F.struct(F.expr(f"4 * at + {k}").alias("table"), F.expr(rotation("word", k)).alias("turned")) for k in range(4)))
    rows = each.withColumn("turn", F.explode(turns)).select("turn.table", "turn.turned", "id", *(f"check{k}" for k in range(CHECKS)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_nodes(batches):
            for table in np.unique(rows[3]).tolist():
                own = rows[4:, rows[3] == table]
                found = list(classes(own[0].view(np.uint64), own[2:].view(np.uint64), own[1]))
                size = [len(ids) for ids in found]
                name = np.array([xxh64_intdigest(ids.tobytes(), SEED) for ids in found], dtype=np.uint64).view(np.int64)
                columns = [np.repeat(name, size), np.concatenate(found) if found else name, np.repeat(size, size), np.repeat([ids[0] for ids in found], size)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bucket", "node", "n", "first"])

    found = by_lead(rows, "table", node_rows).mapInArrow(search, "bucket long, node long, n long, first long")
    return found.dropDuplicates(["bucket", "node"])


def _sets(docs: DataFrame) -> DataFrame:
    """node and shingles of (doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (b.slice(a, _PIECE) for b in batches for a in range(0, b.num_rows, _PIECE)):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            nodes, lists = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, lists], names=["node", "shingles"])

    return docs.mapInArrow(compute, "node long, shingles array<long>")


def meet(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the classes (by root) of all alike sets; sets of one class aren't compared."""
    _, first, group = np.unique(root, return_index=True, return_inverse=True)
    was = first[group]
    label = was.copy()
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(np.r_[0, size])
    here = np.zeros(code.max(initial=0) + 1, dtype=np.int64)
    u, v = [], []
    for k in range(len(sets)):
        if not size[k] or (label == label[k]).all():
            continue
        own = code[start[k] : start[k + 1]]
        here[own] = 1
        # a set without shingles is a node of its own and like no other
        both = np.where(size > 0, np.add.reduceat(np.r_[here[code], 0], np.minimum(start[:-1], len(code))), 0)
        here[own] = 0
        x = np.flatnonzero((both * JOINT >= (size + size[k] - both) * SHARED) & (label != label[k]))
        if len(x):
            _, one = np.unique(label[x], return_index=True)
            u += [k] * len(one)
            v += x[one].tolist()
            label = merge_labels(label, np.full(len(x), k), x)
    return node[np.array(u, dtype=np.int64)], node[np.array(v, dtype=np.int64)]


def _meetings(shared: DataFrame, roots: DataFrame, sets: DataFrame, part_nodes: int) -> DataFrame:
    """(u, v) links between classes that share a bucket of over two nodes.

    A bucket of over ``part_nodes`` nodes is cut into parts by a hash, and every two
    parts meet; no pair is lost. Buckets all of one class need no meeting.
    """
    rows = shared.filter("n > 2").select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b")
    rows = rows.join(mixed.select("bucket", F.ceil(F.col("n") / part_nodes).alias("parts")), "bucket")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "root").join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        forget()
        node, root = (table.column(c).to_numpy() for c in ("node", "root"))
        u, v = meet(node, root, [s.values.to_numpy() for s in table.column("shingles")])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def components(docs: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """(doc_id, text) to doc_id and component_id, the least id reachable over alike pairs.

    Texts of equal shingles are one node. Nodes that a tree of SimHashes joins are a
    bucket, and compared by their shingles: each with the bucket's least, which joins
    most copies at a cost that grows with their number, then, where a bucket still
    holds several classes, all pairs of different classes. Null ids never name a component.
    """
    spark = docs.sparkSession
    prepare(spark)
    prints = stage(_prints(docs), "prints")
    unique = stage(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")), "nodes")
    shared = stage(_buckets(unique), "buckets")
    wanted = shared.select("node").distinct()
    ids = unique.join(wanted, "node").select("least").distinct()
    # the rows of an id may have several texts: what is wanted is known by its node
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.least), "left_semi")
    sets = stage(_sets(texts).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")
    pairs = shared.filter("node != first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    links = stage(pairs.join(a, "u").join(b, "v").filter(alike(F.col("a"), F.col("b"))).select("u", "v"), "first-links")
    more = _meetings(shared, star_components(links), sets, part_nodes)
    roots = star_components(links.unionByName(more))
    nodes = unique.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node").join(nodes.join(names, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component, all columns kept.

    Null and empty texts are copies of each other; repeated rows of a kept id stay;
    rows with a null id can't be told apart and stay or go together, as one id does:
    they stay if any of them is in a component of which no id is known.
    """
    groups = components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return without(docs, groups, id_col)
