"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from shirabe.plans.catalogue import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf_dir, name):
    q = QUERIES[name]
    names, want = duck(sf_dir, q.sql)
    df = q.run(spark, sf_dir)
    assert set(df.columns) == set(names)
    got = [plain(tuple(r)) for r in df.select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain(r)) for r in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
