"""Every query with an SQL statement equals it on a small table; the others run."""

import json

import pytest

import __spark_entry__
from scriptorium.plans import catalogue
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return round(value, 9)
    return value if isinstance(value, (bool, int, type(None))) else str(value)


def lines(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(json.dumps([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    got = __spark_entry__.queries()[name](spark, SF)
    asked = database.execute(__spark_entry__.oracle_sql()[name])
    names, rows = [d[0] for d in asked.description], asked.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert lines(got.columns, got.collect()) == lines(names, rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
