"""Hard negatives by inner product: rows sorted by (pivot, distance), searched in growing annuli."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, release, stage

#: Positives of an anchor, and negatives of a positive.
POSITIVES = 5
NEGATIVES = 10
ANCHOR_EVERY = 100
#: Pivots, and the rows, least by hash of their id, that they are fitted on. Any pivots give the same results.
PIVOTS = 32
PIVOT_SAMPLE = 4096
#: Rows in a block of the index, anchors in a tile, and tiles that meet a block in one task.
BLOCK = 2048
TILE = 256
SQUARE = 64
#: Cells that the range of distances is cut into, to look up overlapping key intervals.
CELLS = 256
#: Components are below this in magnitude when scaled, so that scores fit 64 bits.
LARGEST = 1 << 28
_ANY = 1 << 62
_STRIPE = 256


def _whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, norm (squared length) and vec (components floor(256 x) as bytes) of every row that takes part."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
            flat = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # null components are NaN here
            bad = np.r_[0, np.cumsum(~(np.abs(flat) < LARGEST))]
            end = np.cumsum(size)
            fine = (bad[end] == bad[end - size]) & ~lists.is_null().to_numpy(zero_copy_only=False)
            whole = np.where(np.abs(flat) < LARGEST, flat, 0).astype("<i4")
            square = np.r_[0, np.cumsum(whole.astype(np.int64) ** 2)]
            rows = np.flatnonzero(fine)
            vecs = [whole[end[k] - size[k] : end[k]].tobytes() for k in rows.tolist()]
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array((square[end] - square[end - size])[rows]), pa.array(vecs, pa.binary())], names=["vec_id", "label", "norm", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select("vec_id", label.alias("label"), "v")
    whole = rows.mapInArrow(scale, "vec_id long, label long, norm long, vec binary")
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm")).alias("r")).select("vec_id", "r.label", "r.norm", "r.vec")


def _opened(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    if all(len(v) == 4 * dim for v in raw):
        return np.frombuffer(b"".join(raw), dtype="<i4").reshape(-1, dim)
    return np.frombuffer(b"".join(v.ljust(4 * dim, b"\0") for v in raw), dtype="<i4").reshape(-1, dim)


def augmented(x: np.ndarray, norm: np.ndarray, largest: int) -> np.ndarray:
    """Rows with one more coordinate that makes all of them equally long, so that products order them as distances do."""
    return np.c_[x.astype(np.float64), np.sqrt(np.maximum(0.0, float(largest) - norm))]


def pivots_of(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Centres of the sample by Lloyd's method, from spread-out rows on."""
    centre = x[:: max(1, len(x) // count)][:count].copy()
    for _ in range(rounds):
        near = distances(x, centre).argmin(axis=1)
        for k in range(len(centre)):
            if (own := near == k).any():
                centre[k] = x[own].mean(axis=0)
    return centre


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties by smaller id; -inf never counts."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        row, column = np.nonzero(score > -np.inf)
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    top = np.arange(len(row)) - first < k
    return row[top], column[top]


class _Index:
    """The rows in blocks along (pivot, distance), and the anchors in tiles of the same order."""

    def __init__(self, whole: DataFrame, anchor_every: int, pivots: int, block: int, tile: int):
        self.spark = spark = whole.sparkSession
        self.whole = stage(whole, "whole-vectors")
        most = self.whole.agg(F.max("norm").alias("norm"), F.max(F.length("vec")).alias("bytes"), F.count("*").alias("n")).first()
        self.rows, self.largest, self.dim = most.n, most.norm or 0, (most.bytes or 0) // 4
        self.far = 2 * math.sqrt(self.largest) + 1
        self.slack = 1e-6 * self.far
        if not self.rows:
            return
        sample = self.whole.select("vec_id", "norm", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
        seen = augmented(_opened([bytes(r.vec) for r in sample], self.dim), np.array([r.norm for r in sample]), self.largest)
        self.centres = spark.sparkContext.broadcast(pivots_of(seen, pivots))
        self.pivots = len(self.centres.value)
        self.blocks = stage(self._sorted(block), "key-blocks")
        self.tiles = stage(self._anchors(anchor_every, tile), "anchor-tiles")
        self.parts = max(1, -(-self.tiles.count() // SQUARE))

    def _sorted(self, size: int) -> DataFrame:
        dim, largest, centres = self.dim, self.largest, self.centres

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = augmented(_opened(batch.column(3).to_pylist(), dim), batch.column(2).to_numpy(), largest)
                away = distances(x, centres.value)
                near = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(away[np.arange(len(x)), near])], names=["vec_id", "label", "norm", "vec", "pivot", "key"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            names = ["vec_id", "label", "vec", "pivot", "key"]

            def made(rows: list[tuple]) -> pa.RecordBatch:
                nonlocal number
                number += 1
                ids, labels = (np.array([r[k] for r in rows], dtype="<i8").tobytes() for k in (0, 1))
                return pa.RecordBatch.from_pydict({"block": [number - 1], "pivot": pa.array([rows[0][3]], pa.int32()), "low": [rows[0][4]], "high": [rows[-1][4]], "ids": [ids], "labels": [labels], "vecs": [_opened([r[2] for r in rows], dim).tobytes()]})

            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                    if held and (row[3] != held[0][3] or len(held) >= size):
                        yield made(held)
                        held = []
                    held.append(row)
            if held:
                yield made(held)

        keyed = stage(self.whole.select("vec_id", "label", "norm", "vec").mapInArrow(key, "vec_id long, label long, norm long, vec binary, pivot int, key double"), "keyed-vectors")
        dealt = keyed.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
        return dealt.mapInArrow(pack, "block long, pivot int, low double, high double, ids binary, labels binary, vecs binary")

    def _anchors(self, every: int, size: int) -> DataFrame:
        dim, centres = self.dim, self.centres

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32

            def made(rows: list[tuple]) -> pa.RecordBatch:
                nonlocal number
                number += 1
                ids, labels, own = (np.array([r[k] for r in rows], dtype="<i8").tobytes() for k in (0, 1, 2))
                x = np.stack([r[3] for r in rows])
                # an anchor's own added coordinate is 0: only the rows' lengths are to be evened out
                toward = distances(np.c_[x.astype(np.float64), np.zeros(len(x))], centres.value)
                return pa.RecordBatch.from_pydict({"tile": [number - 1], "ids": [ids], "labels": [labels], "own": [own], "vecs": [x.astype("<i4").tobytes()], "toward": [toward.astype("<f8").tobytes()]})

            held: list[tuple] = []
            for batch in batches:
                for block, ids, labels, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                    x = np.frombuffer(vecs, "<i4").reshape(len(ids), dim)
                    for k in np.flatnonzero(ids % every == 0).tolist():
                        held.append((ids[k], labels[k], block, x[k].copy()))
                        if len(held) >= size:
                            yield made(held)
                            held = []
            if held:
                yield made(held)

        return self.blocks.select("block", "ids", "labels", "vecs").mapInArrow(pack, "tile long, ids binary, labels binary, own binary, vecs binary, toward binary")

    def anchors(self) -> DataFrame:
        """tile, pos, anchor_id and norm of every anchor."""
        dim = self.dim

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tile, ids, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.frombuffer(ids, "<i8")
                    norm = (np.frombuffer(vecs, "<i4").reshape(len(ids), dim).astype(np.int64) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([tile] * len(ids)), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids), pa.array(norm)], names=["tile", "pos", "anchor_id", "norm"])

        return self.tiles.select("tile", "ids", "vecs").mapInArrow(each, "tile long, pos int, anchor_id long, norm long")

    def _asked(self, wants: DataFrame) -> DataFrame:
        """The tiles with what is still wanted of them, as bytes."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    asks = batch.column(1)[k].values
                    column = lambda c, t: asks.field(c).to_numpy(zero_copy_only=False).astype(t).tobytes()  # noqa: E731, B023
                    yield pa.RecordBatch.from_pydict({"tile": [batch.column(0)[k].as_py()], "whats": [b"".join(column(c, "<i8") for c in ("pos", "want", "least", "most"))], "radii": [b"".join(column(c, "<f8") for c in ("done", "radius"))]})

        each = wants.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("pos", "want", "least", "most", "done", "radius"))).alias("asks"))
        return self.tiles.join(each.mapInArrow(pack, "tile long, whats binary, radii binary"), "tile")

    def _spans(self, asked: DataFrame) -> DataFrame:
        """For each tile and pivot the range of keys that any of its annuli covers."""
        pivots = self.pivots

        def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tile, toward, whats, radii in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    pos = np.frombuffer(whats, "<i8").reshape(4, -1)[0]
                    away, radius = np.frombuffer(toward, "<f8").reshape(-1, pivots)[pos], np.frombuffer(radii, "<f8").reshape(2, -1)[1]
                    low, high = np.maximum(0, (away - radius[:, None]).min(axis=0)), (away + radius[:, None]).max(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([tile] * pivots), pa.array(np.arange(pivots), pa.int32()), pa.array(low), pa.array(high)], names=["tile", "pivot", "from", "to"])

        return asked.select("tile", "toward", "whats", "radii").mapInArrow(cover, "tile long, pivot int, from double, to double")

    def _pairs(self, asked: DataFrame, first: bool) -> DataFrame:
        """(tile, block) of all that may have to meet."""
        if first:
            def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    each = [np.unique(np.frombuffer(b, "<i8")) for b in batch.column(1).to_pylist()]
                    tile = np.repeat(batch.column(0).to_numpy(), list(map(len, each)))
                    yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(np.concatenate(each) if each else [], pa.int64())], names=["tile", "block"])

            return asked.select("tile", "own").mapInArrow(own, "tile long, block long")
        cell = lambda c: F.least(F.floor(F.col(c) * (CELLS / self.far)), F.lit(CELLS))
        spans = self._spans(asked).withColumn("c", cell("from")).withColumn("cell", F.explode(F.sequence("c", cell("to"))))
        keys = self.blocks.select("block", "pivot", "low", "high").withColumn("d", cell("low")).withColumn("cell", F.explode(F.sequence("d", cell("high"))))
        # two that overlap in several cells meet in the first of them
        return spans.join(keys, ["pivot", "cell"]).filter("low <= to AND high >= from AND cell = greatest(c, d)").select("tile", "block")

    def _scan(self, asked: DataFrame, first: bool, same: bool, k: int) -> DataFrame:
        """tile, pos, want, score, vec_id: the best of each block for each want whose new annuli touch it."""
        dim, pivots, largest, slack = self.dim, self.pivots, self.largest, self.slack
        pairs = stage(self._pairs(asked, first).withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(self.parts))), "meetings")
        here = pairs.select("block", "part").distinct().join(self.blocks, "block").withColumn("tile", F.lit(-1).cast("long"))
        there = pairs.join(asked, "tile")
        sent = here.unionByName(there, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", "tile")
        sent = sent.select("block", "part", "tile", "pivot", "low", "high", "ids", "labels", "vecs", "own", "toward", "whats", "radii")
        exact = np.float64 if largest < 1 << 52 else np.int64

        def compare(block: dict, tile: dict) -> Iterator[pa.RecordBatch]:
            pos, want, least, most = np.frombuffer(tile["whats"], "<i8").reshape(4, -1)
            done, radius = np.frombuffer(tile["radii"], "<f8").reshape(2, -1)
            own = np.frombuffer(tile["own"], "<i8")[pos] == block["block"]
            away = np.frombuffer(tile["toward"], "<f8").reshape(-1, pivots)[pos, block["pivot"]]
            nearest = np.maximum(0, np.maximum(away - block["high"], block["low"] - away))
            asks = own if first else ~own & (nearest > done) & (nearest <= radius)
            # rows nearer than this score above what is wanted
            q = np.frombuffer(tile["vecs"], "<i4").reshape(-1, dim)
            inner = np.sqrt(np.maximum(0.0, (q.astype(np.float64) ** 2).sum(axis=1)[pos] + largest - 2.0 * most)) - slack
            asks = np.flatnonzero(asks & (away + block["high"] >= inner))
            for a in range(0, len(asks), _STRIPE):
                at = asks[a : a + _STRIPE]
                who, back = np.unique(pos[at], return_inverse=True)
                score = (q[who].astype(exact) @ block["x"].T)[back]
                label = np.frombuffer(tile["labels"], "<i8")[pos[at], None]
                ids = np.frombuffer(tile["ids"], "<i8")[pos[at], None]
                fits = ((block["labels"] == label) == same) & (block["ids"] != ids) & (score >= least[at, None]) & (score <= most[at, None])
                i, j = best(np.where(fits, score, -np.inf), block["ids"], k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([tile["tile"]] * len(i)), pa.array(pos[at][i], pa.int32()), pa.array(want[at][i], pa.int32()), pa.array(score[i, j].astype(np.int64)), pa.array(block["ids"][j])], names=["tile", "pos", "want", "score", "vec_id"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (batch.slice(n, 1).to_pylist()[0] for batch in batches for n in range(batch.num_rows))
            for _, held in groupby(rows, key=lambda r: (r["block"], r["part"])):
                block = next(held)  # its row comes before the tiles
                block |= {"ids": np.frombuffer(block["ids"], "<i8"), "labels": np.frombuffer(block["labels"], "<i8"), "x": np.frombuffer(block["vecs"], "<i4").reshape(-1, dim).astype(exact)}
                for tile in held:
                    yield from compare(block, tile)

        return sent.mapInArrow(meet, "tile long, pos int, want int, score long, vec_id long")

    def search(self, wants: DataFrame, same: bool, k: int) -> DataFrame:
        """(tile, pos, want, norm, least, most) to tile, pos, want, score, vec_id and rank of the k best rows of the wanted label.

        An anchor's own block comes first and tells how far its k-th best may lie.
        Then annuli about the anchor grow in the sorted keys of every pivot: a
        block is read once the difference of its keys to the anchor's distance
        from the pivot, which no row of it can come nearer than, falls within the
        radius. A want is settled when its radius reaches the k-th best found or
        the least score wanted, beyond which nothing better can lie.
        """
        reach = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("norm").cast("double") + self.largest - 2.0 * s)) + 2 * self.slack
        state = stage(wants.select("tile", "pos", "want", "norm", "least", "most", F.lit(-1.0).alias("done"), F.lit(-1.0).alias("radius")), "wants")
        found, first = None, True
        while True:
            asked = stage(self._asked(state), "asked")
            news = self._scan(asked, first, same, k)
            rank = F.row_number().over(Window.partitionBy("tile", "pos", "want").orderBy(F.desc("score"), "vec_id"))
            was, found = found, stage((news if found is None else news.unionByName(found.drop("rank"))).withColumn("rank", rank).filter(F.col("rank") <= k), "found")
            kth = found.filter(F.col("rank") == k).select("tile", "pos", "want", F.col("score").alias("kth"))
            now = state.join(kth, ["tile", "pos", "want"], "left").withColumn("done", F.greatest("done", "radius"))
            needed = F.least(reach(F.coalesce("kth", "least").cast("double")), F.lit(self.far))
            grown = F.greatest(2 * F.col("done"), F.lit(self.far / 16))
            now = now.withColumn("radius", F.when(F.col("kth").isNull(), F.least(needed, grown)).otherwise(needed)).filter(F.col("done") < needed)
            then, state, first = state, stage(now.drop("kth"), "wants"), False
            left = state.count()
            for old in (then, asked, was):
                if old is not None:
                    release(old)
            if not left:
                return found


def mine_negatives(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    anchor_every: int = ANCHOR_EVERY,
    pivots: int = PIVOTS,
    block: int = BLOCK,
    tile: int = TILE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each row is lengthened by one coordinate so that a higher product is a smaller
    distance, goes to its nearest pivot and is sorted by its distance from it.
    Anchors are searched twice: for the best rows of their label, then, for each
    of those, for the best rows of other labels between 0.3 and 0.9 of its score.
    Results are exact; pivots only decide how many blocks are read.

    Rows with a null id, label or vector, with a null or non-finite component, or
    with one of 2^20 or more in magnitude (scores would leave 64 bits) take no
    part. Shorter vectors count as ending in zeros. Of rows that share an id the
    one with the least label (then vector) takes part. A positive with a negative
    score has no negatives. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    index = _Index(_whole(vectors, id_col, vec_col, label_col), anchor_every, pivots, block, tile)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.rows:
        return spark.createDataFrame([], names)
    anchors = stage(index.anchors(), "anchors")
    wants = anchors.select("tile", "pos", F.lit(0).alias("want"), "norm", F.lit(-_ANY).cast("long").alias("least"), F.lit(_ANY).cast("long").alias("most"))
    pairs = index.search(wants, True, positives).filter("score >= 0").select("tile", "pos", F.col("rank").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = stage(pairs.join(anchors, ["tile", "pos"]), "positives")
    wants = pairs.select("tile", "pos", "want", "norm", F.expr("(30 * positive_score + 99) DIV 100").alias("least"), F.expr("90 * positive_score DIV 100").alias("most"))
    found = index.search(wants, False, negatives).select("tile", "pos", "want", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return found.join(pairs, ["tile", "pos", "want"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def negatives_sql(table: str = "embeddings") -> str:
    """The same in DuckDB's SQL: every anchor against every row."""
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM {table} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= {NEGATIVES}"""
