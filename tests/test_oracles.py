"""Each query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from planegrid.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind not in "fiu":
            df[k] = df[k].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    own = ordered(catalog.QUERIES[name](spark, SF).toPandas())
    sql = ordered(duck.sql(catalog.ORACLES[name]).df())
    assert list(own.columns) == list(sql.columns)
    assert len(own) == len(sql)
    for k in own.columns:
        if own[k].dtype.kind in "iu" and sql[k].dtype.kind in "iu":
            assert (own[k].to_numpy() == sql[k].to_numpy()).all(), k
        elif own[k].dtype.kind in "fiu" and sql[k].dtype.kind in "fiu":
            assert np.allclose(own[k].astype(float), sql[k].astype(float), equal_nan=True), k
        else:
            assert (own[k].astype(str) == sql[k].astype(str)).all(), k


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", ["psnr_pairs", "hist_difference", "dpb_output", "nal_packets"])
def test_same_for_any_partitioning(spark, name):
    """What the reference asserts of its threads: the result does not depend on how work is dealt."""
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(ordered(catalog.QUERIES[name](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0].equals(found[1])
