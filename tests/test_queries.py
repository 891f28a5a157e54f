"""Every query against its SQL on the smallest tables; queries without SQL must give rows."""

import os

import duckdb
import pytest

from quire import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages documents conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    place = {c: i for i, c in enumerate(want.columns)}
    assert got == sorted(repr([r[place[c]] for c in columns]) for r in want.fetchall())


def test_partition_counts_do_not_matter(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    results = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(repr, QUERIES[q](spark, FOLDER).collect())) for q in ("plan_split", "anchor_disambiguate", "toc_union", "nav_union_dedup")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.oracle_sql()) <= set(e.oracle_sql())
