"""Each core query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sketchgraph.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {*queries.QUERIES} <= {*__spark_entry__.queries()} and {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
