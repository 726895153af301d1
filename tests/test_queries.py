"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from ctxloom.plans import more_queries as queries
from ctxloom.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, list):
        return tuple(map(plain, value))
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    theirs = duck.execute(queries.ORACLES[name]).to_arrow_table()
    assert rows(queries.QUERIES[name](spark, FOLDER).toArrow()) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert {"query_id", "id", "reason"} <= set(out.columns)
    assert out.where("included").count() > 0
