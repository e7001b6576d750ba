"""Small tables with everything odd in them."""

import pytest

LONG = "word " * 30000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. Again and again it jumps.", "en", 0),
        (2, "The quick brown fox jumps over the lazy dog. Again and again it jumps.", "en", 1),
        (2, "The quick brown fox jumps over the lazy dog. Again and again it jumps.", "en", 1),
        (3, None, None, None),
        (4, "", "", 4),
        (5, LONG, "en", 5),
        (None, "no id at all", "en", 6),
        (7, "İ Σ 日本語 \x1c   😀 <|endoftext|> 'll", "ja", 7),
        (8, "   \n\t ", "en", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, size int").withColumnRenamed("lang", "pid")
