"""Cosine near-duplicates among vectors: tiles in PCA order, products bounded early."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bases, merge_labels, prepare, stage, star_components

THRESHOLD = 0.95
#: Vectors in a tile.
TILE = 4096
#: Vectors, least by hash of their id, that the PCA basis is fitted on. Any
#: orthonormal basis gives the same links; the fit only decides how soon products stop.
PCA_SAMPLE = 4096
#: Leading coordinates whose ranges are kept for each tile.
BOX = 8
#: Tiles are sent to tasks in squares of so many by so many at most: a task holds twice that many.
SQUARE = 8
_STEP = 16
_ROWS = 512
#: Share of a stripe's pairs below which products go on pair by pair; the bounds are the same.
_SPARSE = 0.05
_PAIRS = 8192
_SLACK = 1e-9


def _keyed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """vec_id, key (digest of a usable vector, else null), dim, vec (its bytes); and their type."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.array([n or 0 for n in lists.value_lengths().to_pylist()], dtype=np.int64)
            end = np.cumsum(size)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # null components are NaN here
            bad, other = (np.r_[0, np.cumsum(x)] for x in (~np.isfinite(flat), flat != 0))
            ok = (bad[end] == bad[end - size]) & (other[end] > other[end - size]) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            vecs = [flat[end[k] - size[k] : end[k]].tobytes() if ok[k] else None for k in range(len(size))]
            keys = [None if v is None else hashlib.md5(v, usedforsecurity=False).digest() for v in vecs]
            dims = [int(n) if fine else None for n, fine in zip(size, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "dim", "vec"])

    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
    return rows.mapInArrow(key, "vec_id long, key binary, dim int, vec binary"), kind


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pca_basis(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling energy of the unit vectors x."""
    value, vector = np.linalg.eigh(x.T @ x)
    return vector[:, np.argsort(-value, kind="stable")]


def tile_links(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y with cosine >= threshold, a stripe of x at a time.

    x, y: unit rows; px, py: the same in the PCA basis. Products of the leading
    coordinates are accumulated step by step; what the rest can add is at most
    the product of the two suffix norms, and a pair stops where that can't reach
    the threshold. Pairs left are decided by the full cosine. same: x is y, and
    each pair comes once.
    """
    d = x.shape[1]
    # suffix norms from each coordinate on; 0 after the last
    sx, sy = (np.pad(np.sqrt(np.maximum(0, np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1])), ((0, 0), (0, 1))) for p in (px, py))
    cuts = [*range(_STEP, d, _STEP), d]
    for a in range(0, len(x), _ROWS):
        b = min(a + _ROWS, len(x))
        low = a if same else 0
        part, alive, i, j = 0.0, True, None, None
        if same:
            alive = np.arange(low, len(y))[None, :] > np.arange(a, b)[:, None]
        for c, e in zip([0, *cuts], cuts, strict=False):
            if i is None:
                part = part + px[a:b, c:e] @ py[low:, c:e].T
                alive = alive & (part + np.outer(sx[a:b, e], sy[low:, e]) >= threshold - _SLACK)
                if alive.sum() <= _SPARSE * alive.size:  # few are left: go on pair by pair
                    i, j = np.nonzero(alive)
                    part = part[i, j]
                    i, j = i + a, j + low
            else:
                part = part + np.einsum("ij,ij->i", px[i, c:e], py[j, c:e])
                ok = part + sx[i, e] * sy[j, e] >= threshold - _SLACK
                i, j, part = i[ok], j[ok], part[ok]
        if i is None:
            i, j = np.nonzero(alive & (x[a:b] @ y[low:].T >= threshold))
            yield i + a, j + low
            continue
        for k in range(0, len(i), _PAIRS):
            u, v = i[k : k + _PAIRS], j[k : k + _PAIRS]
            ok = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
            yield u[ok], v[ok]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, square: int = SQUARE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are compared once and counted as often as they occur. Distinct
    vectors are ordered by their first PCA coordinate and cut into tiles; two
    tiles are compared unless the ranges of their leading coordinates lie too far
    apart for the threshold. Tiles travel by squares of neighbours, not once a pair;
    with few tiles the squares are smaller, so that there are enough of them for all
    tasks. A comparison gives each vector's number of links and
    a link to its class, never the pairs. Links have cosine >= threshold in
    double precision.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null id, link with nothing; vectors of different lengths don't
    link. Repeated rows are vectors of their own; an empty table gives no rows;
    other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    prepare(spark)
    keyed, kind = _keyed(vectors, id_col, vec_col)
    rows = stage(keyed, "vectors")
    unique = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("uid"), F.count("*").alias("w"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    unique = stage(unique, "unique-vectors")

    sample: dict[int, list[bytes]] = {}
    for r in unique.select("dim", "vec", F.xxhash64("uid").alias("h")).orderBy("h").limit(PCA_SAMPLE).collect():
        sample.setdefault(r.dim, []).append(bytes(r.vec))
    basis = {d: pca_basis(unit(np.frombuffer(b"".join(v), dtype=kind).reshape(-1, d))) for d, v in sample.items() if len(v) > 1}
    shared = spark.sparkContext.broadcast(basis)  # of the lengths in the sample, PCA_SAMPLE / 2 at most

    def turned(x: np.ndarray) -> np.ndarray:
        b = shared.value.get(x.shape[1])
        return x if b is None else x @ b

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, dims, vecs = np.zeros(batch.num_rows), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for d in np.unique(dims).tolist():
                own, b = np.flatnonzero(dims == d), shared.value.get(d)
                x = unit(np.frombuffer(b"".join(vecs[k] for k in own.tolist()), dtype=kind).reshape(-1, d))
                lead[own] = x[:, 0] if b is None else x @ b[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.float64())], names=["uid", "w", "dim", "vec", "lead"])

    led = unique.select("uid", "w", "dim", "vec").mapInArrow(first, "uid long, w long, dim int, vec binary, lead double")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * n, pa.int32()), pa.array(np.arange(at, at + n))], names=["uid", "w", "dim", "vec", "pid", "local"])
            at += n

    ordered = led.repartitionByRange("dim", "lead", "uid").sortWithinPartitions("dim", "lead", "uid").drop("lead")
    ordered = stage(ordered.mapInArrow(number, "uid long, w long, dim int, vec binary, pid int, local long"), "ordered-vectors")
    base = bases(ordered.groupBy("pid").agg(F.count("*").alias("rows")), "pid", ["rows"])
    placed = ordered.join(base, "pid").withColumn("rank", F.col("rows_before") + F.col("local"))
    placed = placed.select(F.expr(f"rank div {tile}").alias("block"), "dim", "rank", "uid", "w", "vec")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(block: int, dim: int, held: list[tuple]) -> pa.RecordBatch:
            raw = b"".join(v for _, _, v in held)
            p = turned(unit(np.frombuffer(raw, dtype=kind).reshape(-1, dim)))[:, :BOX]
            ids, w = (np.array([h[k] for h in held], dtype="<i8").tobytes() for k in (0, 1))
            return pa.RecordBatch.from_pydict({"block": [block], "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids], pa.binary()), "ws": pa.array([w], pa.binary()), "vecs": pa.array([raw], pa.binary()), "lo": [p.min(axis=0).tolist()], "hi": [p.max(axis=0).tolist()]})

        now, held = None, []
        for batch in batches:
            for block, dim, _, uid, w, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (block, dim) and held:
                    yield make(*now, held)
                    held = []
                now = (block, dim)
                held.append((uid, w, vec))
        if held:
            yield make(*now, held)

    blocks = placed.repartition("block", "dim").sortWithinPartitions("block", "dim", "rank").mapInArrow(tiles, "block long, dim int, ids binary, ws binary, vecs binary, lo array<double>, hi array<double>")
    blocks = stage(blocks, "tiles")

    # unit vectors with cosine >= threshold lie no farther apart than this, in any coordinates
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    ranges = blocks.select("block", "dim", "lo", "hi")
    cells = F.sequence(F.floor(F.col("lo")[0] / reach), F.floor(F.col("hi")[0] / reach))
    left = ranges.select("dim", F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(cells).alias("cell"))
    around = F.sequence(F.floor(F.col("lo")[0] / reach) - 1, F.floor(F.col("hi")[0] / reach) + 1)
    right = ranges.select("dim", F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(around).alias("cell"))
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(F.lit(0.0), x - y))
    apart = F.zip_with(gap(F.col("alo"), F.col("bhi")), gap(F.col("blo"), F.col("ahi")), lambda x, y: F.greatest(x, y))
    far = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    pairs = left.join(right, ["dim", "cell"]).filter(F.col("a") <= F.col("b")).filter(far <= reach * reach).select("dim", "a", "b").distinct()
    across = max(1, min(square, max(2, blocks.count() // 16)))
    group = lambda c: F.expr(f"{c} div {across}")
    wanted = pairs.select("dim", group("a").alias("ga"), group("b").alias("gb"), F.explode(F.array("a", "b")).alias("block")).distinct()
    meet = wanted.join(blocks, ["dim", "block"]).repartition("dim", "ga", "gb").sortWithinPartitions("dim", "ga", "gb", "block").select("dim", "ga", "gb", "block", "ids", "ws", "vecs", "lo", "hi")

    def links(a: tuple, b: tuple) -> pa.RecordBatch:
        """Links between two tiles: how many each vector has, and another of its class."""
        same = a is b
        ids, w = ((a[k] if same else np.concatenate([a[k], b[k]])) for k in (0, 1))
        shift, n, label = (0 if same else len(a[0])), np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i, j in tile_links(a[2], b[2], a[3], b[3], threshold, same):
            j = j + shift
            n += np.bincount(i, weights=w[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=w[i], minlength=len(ids)).astype(np.int64)
            label = merge_labels(label, i, j)
        has = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has]), pa.array(ids[label[has]])], names=["uid", "n", "near"])

    def opened(row: dict) -> tuple:
        x = unit(np.frombuffer(row["vecs"], dtype=kind).reshape(-1, row["dim"]))
        return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ws"], "<i8"), x, turned(x)

    def near(a: dict, b: dict) -> bool:
        away = np.maximum(0, np.maximum(np.subtract(a["lo"], b["hi"]), np.subtract(b["lo"], a["hi"])))
        return float(away @ away) <= reach * reach

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        for (_, ga, gb), held in groupby(rows, key=lambda r: (r["dim"], r["ga"], r["gb"])):
            held = list(held)
            right = [r for r in held if r["block"] // across == gb]
            for a in (r for r in held if r["block"] // across == ga):
                meets = [b for b in right if b["block"] >= a["block"] and near(a, b)]
                left = opened(a) if meets else None
                for b in meets:
                    yield links(left, left if b is a else opened(b))

    found = stage(meet.mapInArrow(compare, "uid long, n long, near long"), "vector-links")
    roots = star_components(found.filter("uid != near").select(F.col("uid").alias("u"), F.col("near").alias("v")))
    named = (
        unique.select("key", "uid", "w")
        .join(found.groupBy("uid").agg(F.sum("n").alias("n")), "uid", "left")
        .join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    )
    usable = rows.filter("key IS NOT NULL").select("vec_id", "key").join(named, "key")
    others = rows.filter("key IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    return usable.select("vec_id", "n_links", "root").union(others).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"),
    )


def near_vectors_sql(table: str = "embeddings", threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, by all pairs."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {table}
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN l ON r.v = l.u
), c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id"""
