"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows_of(cols, rows):
    plain = lambda v: tuple(plain(x) for x in (v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list, tuple)) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def against_sql(spark, name, queries, sql):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries[name](spark, DIR)
    got = [tuple(r.asDict(True).values()) for r in df.collect()]
    cur = con.execute(sql[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def names():
    from spindrift.plans import queries as plans

    return sorted(plans.SQL)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from spindrift.plans import queries as plans

    against_sql(spark, name, plans.QUERIES, plans.SQL)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
