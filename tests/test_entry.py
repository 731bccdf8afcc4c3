"""Every registered query runs on the smallest tables; those with SQL are compared with it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kilnwork.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.registry().queries) - {"bfr_rounds", "bfr_clusters", "lsh_candidates_all", "lsh_jaccard_pairs_all"}))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        got.collect()
        return
    result = tables.execute(sql)
    names = [c[0] for c in result.description]
    want = [dict(zip(names, row, strict=True)) for row in result.fetchall()]
    assert sorted(got.columns) == sorted(names)
    text = lambda row: tuple(str(row[c]) for c in sorted(names))
    assert sorted(map(text, got.collect())) == sorted(map(text, want))
