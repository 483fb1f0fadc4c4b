"""Every registered query of the word search against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import SMALL
from wordsonar import oracle, queries

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in ("documents", "part", "conversations", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return db


def rows(table, columns):
    plain = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted([tuple(plain(r[c]) for c in columns) for r in table], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    found = [r.asDict() for r in queries.queries()[name](spark, SMALL).collect()]
    table = duck.execute(SQL[name]).to_arrow_table().to_pylist()
    columns = sorted(table[0] if table else found[0] if found else [])
    assert not found or sorted(found[0]) == columns
    assert rows(found, columns) == rows(table, columns)
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["score", "id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
