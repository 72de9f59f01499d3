"""Registered queries against their SQL, on the driver's smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from castleflow import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return int(v) if isinstance(v, bool) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = sql.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in place) for r in rel.fetchall()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
