import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagechron.llm import toxicity
from pagechron.llm.toxicity import events, fit, ordinary_documents, score_documents, threshold_and_scale

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti"]


def corpus(n, seed=1):
    """Invented words; toxic texts hold a few with a stem of their own, seldom the same word twice."""
    rng, rows, labels = random.Random(seed), [], []
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    for k in range(n):
        toxic = int(rng.random() < 0.15)
        text = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            text.insert(rng.randrange(len(text)), "gruz" + word())
        rows.append((k, " ".join(text)))
        labels.append((k, toxic))
    return rows, labels


def plain_events(text):
    """Each code of each word, and its end (0), with up to four before it in the word."""
    out = []
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split(" "):
        codes = [x for c in w for x in ([ord(c)] if ord(c) < 0x800 else [0x800 + ord(c) // 1024, 0x900 + ord(c) % 1024])]
        for k in range(len(codes) + 1 if w else 0):
            out.append((codes[max(0, k - 4) : k], codes[k] if k < len(codes) else 0))
    return out


TEXTS = ["Abc de", "", "x", "É1-ü  long word longer-than-six", "日本語 ok", "a" * 50, "漢字かな交じり文 हिन्दी ไทย 한국어 𠀀b𪛟 ﬁn"]


@pytest.mark.parametrize("text", TEXTS)
def test_events(text):
    want = []
    for before, now in plain_events(text):
        gram = now
        for k, c in enumerate(reversed(before), 1):
            gram |= c << (12 * k)
        want.append(gram)
    e = events([text])
    assert e.gram.tolist() == want
    assert len(e.word_start) == len([w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()])


def test_texts_at_once_are_texts_one_by_one():
    e, each = events(TEXTS), [events([t]) for t in TEXTS]
    assert e.gram.tolist() == [g for x in each for g in x.gram.tolist()]
    assert e.word_doc.tolist() == [k for k, x in enumerate(each) for _ in x.word_start]


def test_no_two_characters_share_their_codes():
    is_word, code = toxicity._characters()
    point = np.flatnonzero(is_word)
    pair = np.where(point < 0x800, code[point] << 12, code[point] << 12 | 0x900 + (point & 0x3FF))
    assert len(np.unique(pair)) == len(point)
    assert code[point].max() < 0x900 and 0 < code[point].min()


def test_events_keep_documents_apart():
    e = events(["ab", None, "", "cd ef"])
    assert e.word_doc.tolist() == [0, 3, 3]


def plain_backoff(texts):
    """Kneser-Ney probabilities of four-character events, by dictionaries."""
    grams = {}
    for t in texts:
        for g in events([t]).gram.tolist():
            grams[g] = grams.get(g, 0) + 1
    counts, above = {}, grams
    for k in range(4, 0, -1):
        now = {}
        for g, a in above.items():
            now.setdefault(g & ((1 << 12 * k) - 1), []).append(a)
        above = {g: sum(a) if k > 1 and g >> 12 * (k - 1) == 0 else len(a) for g, a in now.items()}
        counts[k] = above
    total = sum(counts[1].values())
    p = {g: (a + 0.5) / (total + 2048) for g, a in counts[1].items()}
    for k in range(2, 5):
        s, t = {}, {}
        for g, a in counts[k].items():
            s[g >> 12] = s.get(g >> 12, 0) + a
            t[g >> 12] = t.get(g >> 12, 0) + 1
        p = {g: max(a - 0.75, 0) / s[g >> 12] + 0.75 * t[g >> 12] / s[g >> 12] * p[g & ((1 << 12 * (k - 1)) - 1)] for g, a in counts[k].items()}
    return p


def test_backoff_equals_brute_force(spark):
    texts = [t for _, t in corpus(30)[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.gram: r.p for r in toxicity._shared_backoff(toxicity._gram_counts(docs, {})).collect()}
    want = plain_backoff(texts)
    assert got.keys() == want.keys()
    assert max(abs(got[g] - want[g]) for g in want) < 1e-9


def test_threshold_and_scale():
    rng = np.random.default_rng(1)
    x = rng.normal(size=900)
    x = x[np.abs(x - 0.7) > 0.2]
    y = (x > 0.7).astype(float)
    at, scale = threshold_and_scale(x, y)
    assert scale > 0
    assert ((x >= at) == (y == 1)).mean() > 0.95


def plain_difference(text, toxic, ordinary, everything):
    """The best run of eight words: ln of the two classes' probabilities of each event, by dictionaries, over its length."""
    p = plain_backoff(everything)
    mask = (1 << 12 * 4) - 1

    def model(texts):
        n, total, kinds = {}, {}, {}
        for t in texts:
            for g in events([t]).gram.tolist():
                n[g] = n.get(g, 0) + 1
        for g, c in n.items():
            total[g >> 12] = total.get(g >> 12, 0) + c
            kinds[g >> 12] = kinds.get(g >> 12, 0) + 1
        # an event that no text holds has some shared probability, the same for both classes
        shared = lambda g: p.get(g & mask, 1e-4)
        return lambda g: (max(n.get(g, 0) - 0.75, 0) + 0.75 * kinds[g >> 12] * shared(g)) / total[g >> 12] if g >> 12 in total else shared(g)

    a, b, e = model(toxic), model(ordinary), events([text])
    each = [np.log(a(g)) - np.log(b(g)) for g in e.gram.tolist()]
    ends = [*e.word_start.tolist()[1:], len(each)]
    words = [(sum(each[i:j]), j - i) for i, j in zip(e.word_start.tolist(), ends, strict=True)]
    runs = [words[k : k + 8] for k in range(max(1, len(words) - 7))]
    return max(sum(w for w, _ in r) / max(24, sum(n for _, n in r)) for r in runs)


def test_scores_equal_brute_force(spark):
    """Both class likelihoods, backoff for unseen events and the score, for texts with words that no label has seen."""
    rows, labels = corpus(120)
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold, marks = (lambda k: zlib.crc32(str(k).encode()) % 5), dict(labels)
    counted = {c: [t for k, t in rows if marks[k] == c and fold(k) not in (0, 4)] for c in (0, 1)}
    texts = [t for k, t in rows[:25]] + ["gruzba", "zzz qqq", "ba ke lo mi nu ra so ti ba gruzmi gruzx unseen9 words"]
    got = model.differences(texts)
    want = [plain_difference(t, counted[1], counted[0], [t for _, t in rows]) for t in texts]
    assert np.allclose(got, want, atol=1e-4)
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-model.scale * (got - model.threshold))))
    assert (model.differences(["", None, "!"]) == 0).all()


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_documents(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert len(got) > 100
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    caught = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    assert right > 0.97
    assert caught > 0.9


def test_model_keeps_every_seen_event(spark):
    rows, labels = corpus(900)
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    seen = np.unique(events([t for k, t in rows if fold(k) not in (0, 4)]).gram)
    assert seen.tolist() == model.key.tolist()
    assert np.unique(seen >> 12).tolist() == model.context.tolist()
    assert (model.ratios(model.key) == model.ratio).all()


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(300)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit(docs, m) for m in (marks, other))
    assert (a.key == b.key).all()
    assert np.allclose([a.threshold, a.scale], [b.threshold, b.scale])


def test_odd_rows(spark, odd_docs):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    odd = odd_docs.select("doc_id", "text").unionByName(docs)
    marks = spark.createDataFrame([(k + 1000, t) for k, t in labels] + [(None, 1), (1, None), (999999, 1), (1005, 0)], "doc_id long, toxic int")
    got = score_documents(odd, marks).collect()
    assert len(got) == 309
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = ordinary_documents(odd.withColumn("score", F.lit("x")), marks)
    assert kept.columns == ["doc_id", "text", "score"]
    assert score_documents(odd.limit(0), marks.limit(0)).collect() == []
    assert {r.score for r in score_documents(odd, marks.limit(0)).collect()} == {0.0}


def test_rows_without_an_id_have_no_label(spark):
    docs = spark.createDataFrame([(None, "abc"), (0, "def"), (-1, "ghi")], "doc_id long, text string")
    got = {r.gram: (r.toxic, r.ordinary) for r in toxicity._gram_counts(docs, {0: 1, -1: 0}).collect()}
    letters = {c: got[ord(c)] for c in "adg"}
    assert letters == {"a": (0, 0), "d": (1, 0), "g": (0, 1)}
