"""Every query against its SQL on the smallest tables, as multisets of rows."""

import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in data)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()}))
def test_query_equals_sql(spark, con, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
