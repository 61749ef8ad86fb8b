"""Registered queries against their SQL on the smallest tables.

check_oracle.py does the same at any scale.
"""
import os

import duckdb
import pytest

from check_oracle import TABLES, rows_of
from touchline.workload import COVERS, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) == set(COVERS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not mounted")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rel = db.execute(ORACLE[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall())
