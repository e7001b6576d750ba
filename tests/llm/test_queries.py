from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from pagechron.llm.common import read
from pagechron.llm.decontaminate import Items
from pagechron.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_names():
    assert [q.split("_")[0] for q in queries()] == [f"op{n}" for n in range(1, 14)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order(got.select(*columns).collect()) == order(want.fetchall())


def plain_kept(texts):
    """The least id of each group of texts joined by five-word shingle sets 0.8 alike, all pairs looked at."""
    sets = {}
    for d, t in texts.items():
        words = (t or "").lower().split()
        sets[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {d: d for d in texts}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, joint = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if joint == 0 or 5 * both >= 4 * joint:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {top(d) for d in ids}


def test_pipeline_stage_by_stage(spark):
    """Each stage's decisions, on its own input, against its operator by brute force."""
    docs = read(spark, str(DATA), "documents")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, str(DATA))
    assert clean.columns == columns
    before = {r.doc_id for r in clean.collect()}
    scores = {r.doc_id: r.predicted for r in queries()["op1_toxicity"](spark, str(DATA)).collect()}
    assert before == {d for d, p in scores.items() if not p}

    unique = corpus_pipeline.drop_near_copies(spark, clean, str(DATA))
    assert unique.columns == columns
    kept = {r.doc_id for r in unique.collect()}
    assert kept == plain_kept({r.doc_id: r.text for r in clean.collect()})

    final = corpus_pipeline.drop_benchmark(spark, unique, str(DATA))
    assert final.columns == columns
    items = Items.build([(r.item_id, r.text) for r in read(spark, str(DATA), "benchmark").collect()])
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in unique.collect() if not items.find(r.text)}

    pieces = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in final.collect()}
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
