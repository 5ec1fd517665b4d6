"""Every query of the engine against the same rows from SQL, in another engine."""

from __future__ import annotations

import duckdb
import pytest

from pixelframe.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "part", "events", "documents", "region")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table: list[tuple], order: list[int]) -> list[str]:
    return sorted(repr(tuple(int(v) if isinstance(v, float) and v.is_integer() else v for v in (r[k] for k in order))) for r in table)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sql, name):
    df = queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got and len(df.schema) == len(set(df.columns))
    if name not in oracle_sql():
        return
    want = sql.execute(oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    assert rows(got, [df.columns.index(n) for n in names]) == rows(want.fetchall(), [columns.index(n) for n in names])
