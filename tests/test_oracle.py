"""Queries against their SQL over the smallest tables; the driver does the same over larger ones."""

import glob
import math
import os

import duckdb
import pytest

from refloom.plans import catalog, studies  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(catalog.ORACLE)


def norm(v):
    return (None if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = c.execute(catalog.ORACLE[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    want = sorted((tuple(norm(x[at.index(k)]) for k in cols) for x in r.fetchall()), key=str)
    assert sorted((tuple(norm(x[k]) for k in cols) for x in df.collect()), key=str) == want
