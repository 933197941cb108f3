"""The operators' SQL in DuckDB on the same tables."""

import duckdb
import pytest

from plumbline.llm.queries import ORACLE_SQL, QUERIES


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    by = sorted(df.columns)
    rows = lambda columns, found: sorted((tuple(plain(r[columns.index(c)]) for c in by) for r in found), key=repr)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
