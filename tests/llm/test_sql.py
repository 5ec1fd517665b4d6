"""The queries that SQL can express, against it."""

from __future__ import annotations

import math

import duckdb
import pytest

from pixelframe.llm.jaccard import near_duplicates, oracle
from pixelframe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def sql(text):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.execute(text)


def same(df, text):
    want = sql(text)
    columns = [x[0] for x in want.description]
    names = sorted(columns)
    assert names == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    rows = sorted((tuple(r[columns.index(n)] for n in names) for r in want.fetchall()), key=repr)
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    same(queries()[name](spark, SF), oracle_sql()[name])


def test_pipeline_settings(spark):
    found = near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), 5, 80)
    same(found.select("doc_id", "n_shingles", "component_id"), oracle(5, 80))
