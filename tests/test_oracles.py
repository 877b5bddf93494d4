"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

from tradewind.plans import registry
from tradewind.sources.adapters import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, oracle, tmp_path, name):
    out = str(tmp_path / "out")
    registry.QUERIES[name](spark, DATA).write.parquet(out)
    oracle.execute(f"CREATE OR REPLACE TABLE expected AS {registry.ORACLE_SQL[name]}")
    oracle.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{out}/*.parquet'")
    names = sorted(r[0] for r in oracle.sql("DESCRIBE expected").fetchall())
    assert names == sorted(r[0] for r in oracle.sql("DESCRIBE got").fetchall())
    cols = ", ".join(f'"{c}"' for c in names)
    for a, b in (("expected", "got"), ("got", "expected")):
        assert oracle.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
