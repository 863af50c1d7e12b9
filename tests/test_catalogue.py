"""Every registered grid query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "orders", "events", "embeddings", "lineitem")


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [list(found.columns).index(c) for c in columns]
    want = sorted([norm(r[k]) for k in order] for r in found.fetchall())
    assert sorted([norm(v) for v in r] for r in df.select(*columns).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_augmentations_do_not_depend_on_partitions(spark):
    for name in ("augment_flip", "augment_noise"):
        df = catalogue.queries()[name](spark, DATA)
        once = sorted(map(tuple, df.collect()))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = sorted(map(tuple, catalogue.queries()[name](spark, DATA).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert once == again
