"""The driver's contract: every query runs, and agrees with its SQL where tables are small."""

import os

import pytest

import __spark_entry__ as entry
from nearspark.plans import more_queries as M
from nearspark.plans import queries as Q

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(Q.ORACLE_SQL) <= set(Q.QUERIES)


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text_end", "cost"]


@needs_tables
@pytest.mark.parametrize("name", [*Q.QUERIES, *M.QUERIES])
def test_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    found = entry.queries()[name](spark, TABLES)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    sql = Q.ORACLE_SQL | M.ORACLE_SQL
    if name in sql:
        con = duckdb.connect()
        for table in ("benchmark", "conversations", "documents", "events", "lineitem", "nation", "pages", "part"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TABLES}/{table}.parquet')")
        wanted = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(wanted)
