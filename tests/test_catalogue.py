"""Every query with SQL gives DuckDB's rows; the others run and have rows."""

import duckdb
import pytest

from churnlens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_others_have_rows(spark):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert not catalogue.queries()[name](spark, SF).isEmpty(), name
