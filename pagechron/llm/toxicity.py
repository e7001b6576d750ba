"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage
from .encoding import forget

ORDER = 5
#: A character's code: its code point up to U+07FF (Latin, Greek, Cyrillic, Hebrew, Arabic). Any other
#: is two codes, as if it were two characters: which 1,024 code points it is of, and which of them.
BITS = 12
_WIDE, _LEAD, _TRAIL = 0x800, 0x800, 0x900
DISCOUNT = 0.75
#: Labelled rows that the class counts and the calibration are fitted on, least by
#: hash of their id; of them the remainder-4 rows calibrate, the others are counted.
LABELLED = 150_000
#: Words over which a passage's log-likelihoods are normalised.
PASSAGE = 8
#: Events that a shorter passage is taken to have, so that a word or two is no evidence by length alone.
LEAST = 24
_CHARS = 1 << 19
_ROWS = 1024
_MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]
_TABLES: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter or digit, and its code (or first code) of BITS bits (0: none)."""
    if not _TABLES:
        point = np.arange(0x110000)
        word = np.fromiter((chr(p).isalnum() for p in range(0x110000)), dtype=bool, count=0x110000)
        # letters lie below U+40000, so all first codes lie below _TRAIL
        code = np.where(point < _WIDE, point, _LEAD + (point >> 10) % (_TRAIL - _LEAD))
        _TABLES.extend((word, np.where(word, code, 0).astype(np.int64)))
    return _TABLES[0], _TABLES[1]


@dataclass
class Events:
    """Characters of words, and words' ends, each with what precedes it in its word."""

    gram: np.ndarray  #: the event's code in the lowest bits, older characters above
    word_start: np.ndarray  #: of each word, its first event
    word_doc: np.ndarray  #: of each word, its document


def events(texts: list[str | None]) -> Events:
    """All events of some texts, lower-cased; words are runs of letters and digits."""
    is_word, codes = _characters()
    lowered = [(t or "").lower() for t in texts]
    point = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word, code = is_word[point], codes[point]
    doc_start = np.cumsum([0, *(len(t) + 1 for t in lowered[:-1])])
    wide = word & (point >= _WIDE)
    if wide.any():  # their second codes come in after them
        place = np.cumsum(1 + wide) - (1 + wide)
        at = np.repeat(np.arange(len(point)), 1 + wide)
        word, code = word[at], code[at]
        code[place[wide] + 1] = _TRAIL + (point[wide] & 0x3FF)
        doc_start = place[doc_start]
    index = np.arange(len(word))
    gap = np.maximum.accumulate(np.where(word, -1, index))
    before = np.r_[-1, gap[:-1]]
    depth = index - before - 1  # characters of the word before this place
    at = np.flatnonzero(word | (depth > 0))
    depth = depth[at]
    gram = code[at]
    for k in range(1, ORDER):
        has = depth >= k
        gram[has] |= code[at[has] - k] << (BITS * k)
    start = np.flatnonzero(depth == 0)
    return Events(gram, start, np.searchsorted(doc_start, at[start], side="right") - 1)


def _pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, of bounded length but for a text that is longer itself."""
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= _CHARS:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Model:
    """Log-likelihood ratios of events and of contexts, and the line from the difference to a score."""

    key: np.ndarray  #: every event that a class has seen, ascending
    ratio: np.ndarray
    context: np.ndarray  #: every context that a class has seen, ascending
    backoff: np.ndarray  #: the ratio of an event that neither class has seen there: that of the backoff weights
    threshold: float = 0.0
    scale: float = 1.0
    constant: float | None = None  #: the score of every text where a class has no rows

    def ratios(self, gram: np.ndarray) -> np.ndarray:
        """ln P(event | toxic) - ln P(event | ordinary) of each event."""
        each, back = np.unique(gram, return_inverse=True)
        return np.where(_known(self.key, each), _value(self.key, self.ratio, each), _value(self.context, self.backoff, each >> BITS))[back]

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Per text the highest difference of log-likelihoods, per event, of a run of PASSAGE words (of all, if there are fewer)."""
        out = np.zeros(len(texts))
        for a, b in _pieces(texts):
            e = events(texts[a:b])
            if not len(e.word_start):
                continue
            word = np.add.reduceat(self.ratios(e.gram), e.word_start)
            size = np.diff(np.r_[e.word_start, len(e.gram)])
            first = np.flatnonzero(np.r_[True, e.word_doc[1:] != e.word_doc[:-1]])
            last = np.r_[first[1:], len(word)]
            total, many = np.r_[0.0, np.cumsum(word)], np.r_[0, np.cumsum(size)]
            # a text's last runs are the one that ends it
            begin = np.minimum(np.arange(len(word)), np.repeat(np.maximum(last - PASSAGE, first), last - first))
            end = np.minimum(begin + PASSAGE, np.repeat(last, last - first))
            out[e.word_doc[first] + a] = np.maximum.reduceat((total[end] - total[begin]) / np.maximum(many[end] - many[begin], LEAST), first)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.differences(texts) - self.threshold), -60, 60)))


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at


def _known(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return keys[_place(keys, x)] == x if len(keys) else np.zeros(len(x), dtype=bool)


def _value(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of each x, 0 for what isn't among the keys."""
    return np.where(_known(keys, x), values[_place(keys, x)], 0.0) if len(keys) else np.zeros(len(x))


def threshold_and_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Where the two classes are best told apart, and how steeply, by Newton's method; both classes weigh alike."""
    spread = max(float(x.std()), 1e-9)
    design = np.c_[np.ones(len(x)), x / spread]
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, penalty = np.zeros(2), np.diag([1e-6, ridge * len(y)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (each * p * (1 - p))[:, None]) + penalty, design.T @ (each * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    scale = w[1] / spread
    return (float(-w[0] / scale), float(scale)) if scale > 0 else (float(x.mean()), 1.0)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _gram_counts(docs: DataFrame, known: dict[int, int]) -> DataFrame:
    """gram, n (in all texts), toxic and ordinary (in the counted labelled rows)."""
    sc = docs.sparkSession.sparkContext
    ids = np.array(sorted(known), dtype=np.int64)
    shared = sc.broadcast((ids, np.array([known[i] for i in ids.tolist()], dtype=np.int8)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ids, marks = shared.value
        held: list[np.ndarray] = []
        size = 0

        def compact(parts: list[np.ndarray]) -> np.ndarray:
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            first = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]]) if rows.shape[1] else np.zeros(0, dtype=np.int64)
            return np.vstack([rows[0, first], *(np.add.reduceat(r, first) for r in rows[1:])]) if len(first) else rows

        for batch in (b.slice(a, _ROWS) for b in batches for a in range(0, b.num_rows, _ROWS)):
            doc_ids, given = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, doc_ids)
            at[at == len(ids)] = 0
            mark = np.where(given & (ids[at] == doc_ids), marks[at], -1) if len(ids) else np.full(len(doc_ids), -1)
            texts = batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                e = events(texts[a:b])
                if not len(e.gram):
                    continue
                gram, n = np.unique(e.gram, return_counts=True)
                zero = np.zeros(len(gram), dtype=np.int64)
                held.append(np.vstack([gram, n, zero, zero]))
                size += len(gram)
                each = np.repeat(mark[a:b][e.word_doc], np.diff(np.r_[e.word_start, len(e.gram)]))
                for label in (0, 1):
                    gram, n = np.unique(e.gram[each == label], return_counts=True)
                    zero = np.zeros(len(gram), dtype=np.int64)
                    held.append(np.vstack([gram, zero, *((n, zero) if label else (zero, n))]))
                    size += len(gram)
                if size > 800_000:
                    held = [compact(held)]
                    size = held[0].shape[1]
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(r) for r in held[0]], names=["gram", "n", "toxic", "ordinary"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in compact(held)], names=["gram", "n", "toxic", "ordinary"])

    parts = docs.mapInArrow(count, "gram long, n long, toxic long, ordinary long")
    return parts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "ordinary")))


def _shared_backoff(grams: DataFrame) -> DataFrame:
    """gram of ORDER - 1 characters to its Kneser-Ney probability p, from all texts.

    A gram inside a word counts its distinct left neighbours; one that begins
    where its word begins has no left neighbour and counts its occurrences.
    """
    counts, above = {}, grams.select("gram", F.col("n").alias("a"))
    for k in range(ORDER - 1, 0, -1):
        at_start = F.shiftright(F.col("gram"), BITS * (k - 1)) == 0 if k > 1 else F.lit(False)
        above = above.withColumn("gram", F.col("gram").bitwiseAND(F.lit(_MASK[k]))).groupBy("gram").agg(F.sum("a").alias("sum"), F.count("*").alias("kinds"))
        above = above.select("gram", F.when(at_start, F.col("sum")).otherwise(F.col("kinds")).alias("a"))
        counts[k] = above
    # the few hundred codes are bounded by BITS
    total = counts[1].agg(F.sum("a").alias("total"))
    p = counts[1].join(F.broadcast(total)).select("gram", ((F.col("a") + 0.5) / (F.col("total") + (1 << BITS) / 2)).alias("p"))
    for k in range(2, ORDER):
        level = counts[k].withColumn("context", F.shiftright("gram", BITS))
        context = level.groupBy("context").agg(F.sum("a").alias("s"), F.count("*").alias("t"))
        lower = p.select(F.col("gram").alias("short"), F.col("p").alias("q"))
        level = level.join(context, "context").withColumn("short", F.col("gram").bitwiseAND(F.lit(_MASK[k - 1]))).join(lower, "short")
        p = level.select("gram", (F.greatest(F.col("a") - DISCOUNT, F.lit(0.0)) / F.col("s") + DISCOUNT * F.col("t") / F.col("s") * F.col("q")).alias("p"))
    return p


def _ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram and llr of every event that either class has seen; context and llr of what neither has seen there.

    Both classes back off to the same shared probability, each with its own
    weight, the share of a context's count that discounting sets free. Where
    neither class has seen an event the probability cancels and the weights'
    ratio is left; in a context that neither knows, the ratio is 0.
    """
    seen = grams.filter("toxic + ordinary > 0").withColumn("context", F.shiftright("gram", BITS))
    context = seen.groupBy("context").agg(
        F.sum("toxic").alias("nt"), F.sum("ordinary").alias("no"), F.sum((F.col("toxic") > 0).cast("long")).alias("tt"), F.sum((F.col("ordinary") > 0).cast("long")).alias("to")
    )
    shared = _shared_backoff(grams).select(F.col("gram").alias("short"), "p")
    rows = seen.join(context, "context").withColumn("short", F.col("gram").bitwiseAND(F.lit(_MASK[ORDER - 1]))).join(shared, "short")

    def likelihood(n: str, total: str, kinds: str) -> Column:
        own = F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("p")
        return F.when(F.col(total) > 0, own / F.greatest(F.col(total), F.lit(1))).otherwise(F.col("p"))

    def weight(total: str, kinds: str) -> Column:
        return F.when(F.col(total) > 0, DISCOUNT * F.col(kinds) / F.greatest(F.col(total), F.lit(1))).otherwise(1.0)

    events_ = rows.select("gram", (F.ln(likelihood("toxic", "nt", "tt")) - F.ln(likelihood("ordinary", "no", "to"))).cast("float").alias("llr"))
    return events_, context.select("context", (F.ln(weight("nt", "tt")) - F.ln(weight("no", "to"))).cast("float").alias("llr"))


def _sorted(table, key: str) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table.column(key).to_numpy(), table.column("llr").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows whose crc32 of the id, as text, is not 0 modulo 5.

    The class counts come from at most LABELLED labelled rows; the shared backoff
    counts come from every text. Null ids, null labels and labels without a
    document teach nothing; of several labels of one id the largest holds.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("fold", _fold(F.col("doc_id"))).filter("fold != 0")
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    n, toxic = len(sample), sum(r.toxic for r in sample)
    if not 0 < toxic < n:
        return Model(*[np.zeros(0)] * 4, constant=toxic / (n + 1))
    calibrate = [r for r in sample if r.fold == 4]
    if not 0 < sum(r.toxic for r in calibrate) < len(calibrate):
        calibrate = sample
    grams = stage(_gram_counts(rows, {r.doc_id: r.toxic for r in sample if r.fold != 4 or calibrate is sample}), "grams")
    # as many rows as the labelled sample has events and contexts, whatever the corpus; float32 as they are broadcast
    by_event, by_context = _ratios(grams)
    model = Model(*_sorted(by_event.toArrow(), "gram"), *_sorted(by_context.toArrow(), "context"))

    shared = spark.sparkContext.broadcast(model)
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in calibrate], "doc_id long, toxic int"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, _ROWS) for b in batches for a in range(0, b.num_rows, _ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.differences(batch.column(1).to_pylist()))], names=["toxic", "x"])

    found = rows.join(wanted, "doc_id").select("toxic", "text").mapInArrow(measure, "toxic int, x double").toPandas()
    y = found["toxic"].to_numpy()
    if not 0 < y.sum() < len(y):
        model.constant = float(y.sum() / (len(y) + 1))
    else:
        model.threshold, model.scale = threshold_and_scale(found["x"].to_numpy(), y.astype(float))
    return model


def scorer(docs: DataFrame, model: Model):
    """A function from a text column to its score; the model is broadcast, its size is bounded by the events of LABELLED rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        forget()
        return pd.Series(shared.value.score([None if t is None or t != t else t for t in texts]))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    Null and empty texts have a score too (that of no evidence); rows with a null
    id are scored and never held out; repeated rows repeat; without labels of
    both classes every score is the share of toxic labels; an empty table gives
    no rows; other columns are ignored.
    """
    score = scorer(docs, fit(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
    held_out = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def ordinary_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns kept.

    Null and empty texts score as texts without evidence; repeated rows are kept
    or dropped alike; an empty table gives no rows.
    """
    score = scorer(docs, fit(docs, labels, id_col, text_col))
    return docs.filter(score(F.col(text_col)) < 0.5)
