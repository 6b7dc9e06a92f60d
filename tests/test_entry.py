"""Every registered query runs at the smallest scale; those with SQL agree with it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandex.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def test_entry(spark):
    assert entry.entry(spark).columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    got = df.collect()
    sql = catalogue.ORACLE_SQL.get(name)
    if sql is None:
        return
    c = con.execute(sql)
    names, want = [d[0] for d in c.description], c.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[n]) for n in names) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_find_many_where_items_repeat_in_a_document(spark, tmp_path):
    docs = [(1, "one two one two"), (1, "two one"), (2, "aaaa"), (2, "aaaa"), (None, "é one"), (3, None), (4, "")]
    items = [(1, "one"), (2, "aa"), (2, "aa"), (3, ""), (4, None), (None, "two")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(catalogue.ORACLE_SQL["find_many"]).fetchall()
    got = catalogue.QUERIES["find_many"](spark, str(tmp_path)).select("doc_id", "query_id", "pos").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == 15
