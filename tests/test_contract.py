"""The driver's contract and the agreement of every query with its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    def plain(x):
        if x is None or str(x) in ("<NA>", "nan", "None"):
            return None
        return round(float(x), 5) if isinstance(x, float) or type(x).__name__ in ("Decimal", "float64") else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(str(plain(x)) for x in row) for row in frame.itertuples(index=False)), key=str)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)
