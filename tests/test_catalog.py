"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from pagechron.plans.catalog import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(rows):
    flat = [tuple(round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(flat, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = queries()[name](spark, str(DATA))
    want = db.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(map(tuple, got.select(*columns).collect())) == normal(want.fetchall())


def test_entry_works_without_the_optional_parts(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "OPTIONAL", {k: f"gone/{v}" for k, v in entry.OPTIONAL.items()})
    assert "find_dates" in entry.queries()
    assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    assert entry.entry(spark).count() > 0


def test_a_broken_part_is_no_absent_one(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def without(name, *a):
        if name == "pagechron.llm.queries" and entry.OPTIONAL:
            raise ModuleNotFoundError("No module named 'pagechron.llm.packing'", name="pagechron.llm.packing")
        return real(name, *a)

    monkeypatch.setattr(entry, "OPTIONAL", {"pagechron.llm": "__spark_entry__.py", "corpus_pipeline": "gone"})
    monkeypatch.setattr(entry.importlib, "import_module", without)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
