import duckdb
import pytest

import __spark_entry__ as e
from loomlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


def test_entry(spark):
    out = e.entry(spark)
    assert out.columns == ["id", "k", "v"] and out.where("v <> 0").count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    rel = con.sql(e.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(map(repr, rel.project(", ".join(cols)).fetchall()))
    assert got or name == "missing_feature_ids"  # none are missing at this size
