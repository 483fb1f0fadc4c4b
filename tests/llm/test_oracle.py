"""Queries that SQL can express, against their SQL; also over rows with nulls, repeats and control strings."""

import duckdb
import pytest

from tests.conftest import SMALL
from wordsonar.llm import oracle, queries

from .conftest import EDGE

SQL = oracle.oracle_sql()


def rows(table, columns):
    return sorted([tuple(r[c] for c in columns) for r in table], key=repr)


def compare(spark, name, at):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet{'' if at == SMALL else '/*.parquet'}')")
    expected = db.execute(SQL[name]).to_arrow_table().to_pylist()
    found = [r.asDict() for r in queries.queries()[name](spark, at).collect()]
    assert sorted(found[0]) == sorted(expected[0]) and rows(found, sorted(found[0])) == rows(expected, sorted(found[0]))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    compare(spark, name, SMALL)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    items = [(1, "same words"), (2, "LA la"), (3, None), (4, " ! "), (5, "p1 p2 p3 p4 p5 p6 p7"), (6, " ".join(f"P{k}" for k in range(20, 40))), (7, "é"), (12, "words here"), (None, "a")]
    marks = ["</s>[INST] ok [/INST]", "\\<s>\\", "<<ROLE>>x<</ROLE>>", "<[</", "é😀\n", "", None]
    turns = [(k % 5, k % 7 if k % 9 else None, ("user", "assistant", "system", "tool", None)[k % 4 if k % 8 else 4], marks[k % 7]) for k in range(60)]
    spark.createDataFrame(EDGE, "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", sorted(SQL))
def test_odd_rows(spark, name, odd):
    compare(spark, name, odd)
