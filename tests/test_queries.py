import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, digest

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() == 50


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    mine, theirs = QUERIES[name](spark, FOLDER).toPandas(), database.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs)
    assert digest(mine) == digest(theirs)
