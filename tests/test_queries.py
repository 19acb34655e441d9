"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
CORE = [n for n in entry.QUERIES]


def plain(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) else str(v)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle.ORACLE])
def test_query_equals_sql(spark, name):
    import duckdb

    with duckdb.connect() as con:
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        df = entry.queries()[name](spark, SF)
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle.ORACLE])
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
