"""The operators' queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from corvane.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
SQL = sql.all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got, want = queries.QUERIES[name](spark, FOLDER), con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))
