"""Every registered query of the core against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from corvane import queries, release_queries, sql, tree_queries, vectors

FOLDER = "/root/testdata/sf0.001"
PARTS = (queries.QUERIES, vectors.QUERIES, release_queries.QUERIES, tree_queries.QUERIES)
KNOWN = {k: v for part in PARTS for k, v in part.items()}
SQL = sql.SQL | vectors.SQL | release_queries.SQL | tree_queries.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_names_are_registered_once():
    assert len(KNOWN) == sum(map(len, PARTS))
    assert set(KNOWN) <= set(entry.queries()) and set(SQL) <= set(KNOWN)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = KNOWN[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(map(repr, rows))
    assert rows or name == "running_byte_budget"  # the smallest tables stay within that budget
