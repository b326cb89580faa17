"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewrack.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, found):
    order = sorted(columns)
    return sorted(tuple(str(r[columns.index(c)]) for c in order) for r in found)


#: Queries that SQL can't express, and where they are tested instead.
WITHOUT_SQL = {"router_languages": "test_router_training.py"}


def test_all_but_a_few_queries_have_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cur = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
