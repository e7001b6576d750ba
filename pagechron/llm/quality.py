"""Quality by a support vector machine over n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage
from .encoding import forget
from .toxicity import _fold, _pieces

#: Labelled rows that the model is fitted on, least by hash of their id: those with
#: remainder 4 turn margins into scores, the others teach ratios and weights.
LABELLED = 20_000
#: Labelled documents that an n-gram must occur in.
LEAST_DOCUMENTS = 2
#: What a document on the wrong side costs, against the length of the weights.
COST = 1.0
ROUNDS = 30
SEED = 42
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
_MULTIPLIER = np.int64(-7046029254386353131)
_CHARS = 1 << 19
_TOKENS = 1 << 18
_ROWS = 512
_KEPT = 200_000
#: Shapes of tokens, in the last bits of their hashes: a token like the one before it has a shape of its own.
_BITS = 4
_SAME = 15
_STOPS = {"\n": 6, ".": 7, ",": 8}


class _Hashes(dict):
    """Tokens' hashes, their shapes in the last bits; made when first asked for."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        if token[0].isalpha():
            shape = 1 if token.islower() else 3 if token.isupper() and len(token) > 1 else 2 if token.istitle() else 4 if token.lower() != token.upper() else 5
        else:
            shape = _STOPS.get(token) or (9 if token[0].isdecimal() else 10 if len(token) == 1 else 11)
        h = xxh64_intdigest(token.encode("utf-8", "surrogatepass"), SEED) >> 1 & ~((1 << _BITS) - 1) | shape
        if len(self) >= _KEPT:
            self.clear()
        self[token] = h
        return h


def _distinct(x: np.ndarray) -> np.ndarray:
    """Each value once, ascending."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _hashed(text: str | None, known: _Hashes) -> np.ndarray:
    """A text's tokens as hashes; they are met one by one, so that a very long text is never a list."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    if len(text) < _CHARS:
        tokens = _TOKEN.findall(text)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    return np.fromiter((known[m.group()] for m in _TOKEN.finditer(text)), dtype=np.int64)


def ngrams(texts: list[str | None], known: _Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, n-gram) of all tokens in turn, a bounded number at a time.

    N-grams are tokens, pairs of tokens, and one to three shapes of tokens in a
    row. Tokens are runs of letters (as written), of digits or of other signs,
    and line ends.
    """
    each = [_hashed(t, known) for t in texts]
    token, doc = np.concatenate(each), np.repeat(np.arange(len(texts)), [len(x) for x in each])
    shape = token & ((1 << _BITS) - 1)
    shape[1:][(token[1:] == token[:-1]) & (doc[1:] == doc[:-1])] = _SAME
    for a in range(0, len(token), _TOKENS):
        b = min(a + _TOKENS, len(token))
        yield doc[a:b], token[a:b]
        yield doc[a:b], (1 << 3 * _BITS) | shape[a:b]
        for n in (2, 3):
            first = np.arange(a, min(b, len(token) - n + 1))
            first = first[doc[first] == doc[first + n - 1]]
            code = shape[first]
            for k in range(1, n):
                code = code << _BITS | shape[first + k]
            yield doc[first], (n << 3 * _BITS) | code
            if n == 2:
                with np.errstate(over="ignore"):
                    pair = (token[first] * _MULTIPLIER + token[first + 1]) * _MULTIPLIER
                yield doc[first], pair | np.int64(1 << 62)  # apart from shapes


@dataclass
class Model:
    """The n-grams, ascending, the ratio of each, its weight by the machine, and the line from margins to scores."""

    key: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    threshold: float = 0.0
    scale: float = 1.0
    constant: float | None = None  #: the score of every text where a class has no rows

    def places(self, texts: list[str | None], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
        """(document, place among the n-grams), each once."""
        size, found = max(1, len(self.key)), []
        for doc, key in ngrams(texts, known):
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            has = self.key[at] == key if len(self.key) else np.zeros(len(key), dtype=bool)
            found.append(_distinct(doc[has] * size + at[has]))
        each = _distinct(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return each // size, each % size

    def margins(self, texts: list[str | None], known: _Hashes) -> np.ndarray:
        """Each text's scaled indicators, brought to length 1, times the weights."""
        out = np.zeros(len(texts))
        for a, b in _pieces(texts):
            doc, at = self.places(texts[a:b], known)
            sums = [np.bincount(doc, weights=w, minlength=b - a) for w in (self.ratio[at] * self.weight[at], self.ratio[at] ** 2)]
            out[a:b] = sums[0] / np.sqrt(np.maximum(sums[1], 1e-12))
        return out + self.bias

    def score(self, texts: list[str | None], known: _Hashes) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.margins(texts, known) - self.threshold), -60, 60)))


def dual_coordinate_descent(start: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, own: np.ndarray | None = None, cost: float = COST, rounds: int = ROUNDS, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss: min |w|^2 / 2 + cost * sum of max(0, 1 - y (w x + b)), b counted in |w|.

    Row i holds value[start[i]:start[i + 1]] at those places; ``own`` names the
    rows that count, in their order. Each step solves the
    dual for one row's multiplier, held between 0 and the cost, and moves the
    weights along that row; rows come in a new random order each round.
    """
    rng, w, bias = np.random.default_rng(SEED), np.zeros(size), 0.0
    own = np.arange(len(y)) if own is None else own
    multiplier = np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in own[rng.permutation(len(own))].tolist():
            at, v = place[start[i] : start[i + 1]], value[start[i] : start[i + 1]]
            slope = y[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(multiplier[i] - slope / (float(v @ v) + 1.0), 0.0), cost)
            step = (new - multiplier[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                multiplier[i] = new
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return w, bias


def sigmoid_line(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Threshold and scale of the likeliest 1 / (1 + exp(-scale (x - threshold))), by Newton's method with softened labels."""
    positive = y.sum()
    goal = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    design, w = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (goal - p) - 1e-6 * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return (float(-w[0] / w[1]), float(w[1])) if w[1] > 0 else (float(x.mean()), 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most LABELLED labelled rows whose crc32 of the id, as text, is not 0 modulo 5.

    Null ids, null labels and labels without a document teach nothing; of several
    labels of one id the largest holds.
    """
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    marks = marks.withColumn("fold", _fold(F.col("doc_id"))).filter("fold != 0")
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    n, good = len(sample), sum(r.quality for r in sample)
    if not 0 < good < n:
        return Model(*[np.zeros(0)] * 3, constant=good / (n + 1))
    calibrate = {r.doc_id for r in sample if r.fold == 4}
    if not 0 < sum(r.quality for r in sample if r.doc_id in calibrate) < len(calibrate) or not 0 < sum(r.quality for r in sample if r.doc_id not in calibrate) < n - len(calibrate):
        calibrate = {r.doc_id for r in sample}  # too few rows to spare some
    teach = lambda d: d not in calibrate or len(calibrate) == n
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, r.quality, r.doc_id in calibrate, teach(r.doc_id)) for r in sample], "doc_id long, quality int, calibrates boolean, teaches boolean"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = _Hashes()
        for batch in (b.slice(a, _ROWS) for b in batches for a in range(0, b.num_rows, _ROWS)):
            texts = batch.column(3).to_pylist()
            for a, b in _pieces(texts):
                doc, key = (np.concatenate(x) for x in zip(*ngrams(texts[a:b], known), strict=True)) if any(texts[a:b]) else [np.zeros(0, dtype=np.int64)] * 2
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
                starts = np.searchsorted(doc[new], np.arange(b - a + 1))
                keys = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(key[new]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), keys], names=["quality", "calibrates", "teaches", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id").select("quality", "calibrates", "teaches", "text")
    rows = stage(rows.mapInArrow(extract, "quality int, calibrates boolean, teaches boolean, keys array<long>"), "labelled-ngrams")
    counts = rows.filter("teaches").select("quality", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    # as many rows as the labelled sample has n-grams, whatever the corpus
    table = counts.filter(F.col("n") >= LEAST_DOCUMENTS).toArrow()
    order = np.argsort(table.column("key").to_numpy())
    key, good, many = (table.column(c).to_numpy()[order] for c in ("key", "good", "n"))
    p, q = good + 1.0, many - good + 1.0
    model = Model(key, (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32), np.zeros(len(key), dtype=np.float32))
    del table, order, good, many, p, q

    shared = spark.sparkContext.broadcast(model.key)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            at = np.searchsorted(shared.value, flat)
            at[at == len(shared.value)] = 0
            has = shared.value[at] == flat if len(shared.value) else np.zeros(len(flat), dtype=bool)
            starts = np.r_[0, np.cumsum(has)][ends]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at[has], pa.int32()))], names=["quality", "calibrates", "teaches", "at"])

    found = rows.mapInArrow(indexed, "quality int, calibrates boolean, teaches boolean, at array<int>").toArrow()
    lists = found.column("at").combine_chunks()
    place, start = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    y, calibrates, teaches = (found.column(c).to_numpy() for c in ("quality", "calibrates", "teaches"))
    value = model.ratio[place]
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        value[a:b] /= max(float(np.linalg.norm(value[a:b])), 1e-6)
    own = np.flatnonzero(teaches)
    if not 0 < y[own].sum() < len(own):
        model.constant = float(y.sum() / (len(y) + 1))
        return model
    # rows in an order of their own, so that the fit does not hang on how Spark has dealt them
    own = own[np.lexsort(([int(place[start[i] : start[i + 1]].sum()) for i in own.tolist()], np.diff(start)[own]))]
    weight, model.bias = dual_coordinate_descent(start, place, value, np.where(y == 1, 1.0, -1.0), len(key), own)
    model.weight = weight.astype(np.float32)
    margin = np.array([float(value[a:b] @ model.weight[place[a:b]]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]) + model.bias
    c = np.flatnonzero(calibrates)
    if not 0 < y[c].sum() < len(c):
        c = np.arange(len(y))
    model.threshold, model.scale = sigmoid_line(margin[c], y[c].astype(float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3 on) of every row, from its whole text alone.

    Null and empty texts have a score too (that of no n-grams); rows with a null
    id are scored and never held out; repeated rows repeat; without labels of
    both classes every score is the share of good labels; an empty table gives no
    rows; other columns are ignored. What is broadcast is bounded by the n-grams
    of LABELLED rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        known = _Hashes()
        for texts in batches:
            yield pd.Series(shared.value.score([None if t is None or t != t else t for t in texts], known))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
    held_out = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
