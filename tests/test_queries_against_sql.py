"""Every query that has SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from gaugeworks.plans import folds, rules
from gaugeworks.plans import queries as plans

assert rules

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL | folds.SQL))
def test_same_rows(spark, db, name):
    df = (plans.QUERIES | folds.QUERIES)[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    cursor = db.execute((plans.SQL | folds.SQL)[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
