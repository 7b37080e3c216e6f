"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from claimloom.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame, names):
    return sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        assert rows(got, names) == rows(want, names)


def test_pair_ordinals(spark):
    from claimloom.operators.vectors import pair_ordinal, pair_page, pair_total

    n = 37
    got = [(r.ord, r.i, r.j) for r in pair_page(spark, n, 5, 300).orderBy("ord").collect()]
    want = [(pair_ordinal(i, j, n), i, j) for i in range(n) for j in range(i + 1, n)]
    assert got == want[5:305]
    big = 3_000_001
    last = pair_total(big) - 1
    r = pair_page(spark, big, last, 1).first()
    assert (r.i, r.j) == (big - 2, big - 1) and not math.isnan(r.i)
