"""Every engine query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from sieveline import queries as engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    frame = engine.queries()[name](spark, FOLDER)
    relation = database.sql(engine.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(relation.fetchall(), relation.columns)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert engine.queries()[name](spark, FOLDER).count() > 0
