"""The corpus pipeline's stages on odd rows and empty tables."""

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark with nulls, repeats and ids that no document has."""
    path = tmp_path_factory.mktemp("odd")
    labels = [(1, 1, 0), (2, 0, 0), (2, 1, None), (5, None, 0), (None, 1, 1), (77, 0, 1), (6, 1, 1), (9, 0, 1), (11, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{path}/labels.parquet")
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (None, "one two three four five six seven")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def rows(spark):
    copy = "The quick brown fox jumps over the lazy dog again and again, until it is tired of it. "
    held = "Before it: alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu, and after it."
    data = [(1, copy, "en", 1), (2, copy, "en", 2), (2, copy, "en", 2), (3, None, None, None), (4, "", "", 0), (5, "word " * 30000, "en", 5), (None, "no id at all, but words of its own", "en", 6), (None, copy, "xx", 1), (7, held, "en", 7), (8, " \n\t", "en", 8)]
    return spark.createDataFrame(data, "doc_id long, text string, shard string, size int").selectExpr("*", "1 AS score", "'p' AS node")


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_columns_and_take_odd_rows(spark, folder, rows, stage):
    name, step = corpus_pipeline.STAGES[stage]
    out = step(spark, rows, folder)
    assert out.columns == rows.columns
    key = lambda r: tuple(map(str, r))
    got, given = sorted(map(key, out.collect())), sorted(map(key, rows.collect()))
    assert all(got.count(r) == given.count(r) for r in got)  # repeats go or stay together
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    if name == "simhash_near_dedup":
        assert ids == [-1, -1, 1, 3, 5, 7]  # one row without an id has no copy with one
    if name == "decontamination":
        assert ids == [-1, -1, 1, 2, 2, 3, 4, 5, 8]
    empty = step(spark, rows.limit(0), folder)
    assert empty.columns == rows.columns and empty.collect() == []


def test_packing_takes_odd_rows(spark, folder, rows):
    step = corpus_pipeline.STAGES[3][1]
    pieces = step(spark, rows, folder).collect()
    by_id = {}
    for r in pieces:
        by_id.setdefault(r.doc_id, []).append(r)
    assert set(by_id) == {r.doc_id for r in rows.collect()}
    assert [(r.length, r.doc_tokens) for r in by_id[3]] == [(1, 1)] and [(r.length, r.doc_tokens) for r in by_id[4]] == [(1, 1)]
    assert sum(r.length for r in by_id[2]) == 2 * by_id[2][0].doc_tokens
    assert step(spark, rows.limit(0), folder).collect() == []
