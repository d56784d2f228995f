"""Every registered query of the engine against its SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from tenderspark.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 4))
    return str(v)[:19] if isinstance(v, (datetime.datetime, datetime.date)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in ORACLE_SQL:
        assert len(cols) == len(set(cols))
        return
    r = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(norm(x[c]) for c in cols) for x in rows) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["year", "total", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
