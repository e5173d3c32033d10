"""The driver's contract, and that the core needs nothing of the llm subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "ordinal", "p_partkey", "p_name"] and df.limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_llm_imports_it():
    for path in [*ROOT.glob("corvane/*.py"), *(p for d in ("functions", "operators", "sources", "plans", "streaming") for p in ROOT.glob(f"corvane/{d}/*.py"))]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_core_queries_agree_with_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    known = entry.queries()
    for name in ("resolved_citations", "grouped_bibliography", "snapshot_diff", "payload_digest", "locale_path", "reading_minutes", "set_operations"):
        got = known[name](spark, folder)
        want = con.execute(entry.core_sql.SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall())), name
