"""The operators that SQL can express, against their SQL on the smallest tables."""

import os

import pytest

from tradewind.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    out = str(tmp_path / "out")
    queries.QUERIES[name](spark, DATA).write.parquet(out)
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    con.execute(f"CREATE TABLE expected AS {queries.ORACLE_SQL[name]}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    cols = ", ".join(r[0] for r in con.execute("DESCRIBE expected").fetchall())
    for a, b in (("expected", "got"), ("got", "expected")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
