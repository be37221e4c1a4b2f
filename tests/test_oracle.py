"""Every registered query equals its DuckDB oracle on the generated tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from deskpark.plans import registry
from deskpark.plans.compare import canonical

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, key):
    df = registry.queries()[key](spark, SF_SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(registry.oracle_sql()[key])
    want = canonical(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "id_ticket" in df.columns and "total" in df.columns
