"""Every query that SQL can express against DuckDB on the smallest given tables."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

from tideline.plans import registry  # noqa: E402


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    return repr(round(value, 8)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted("|".join(normal(r[c]) for c in names) for r in df.collect())
    out = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    want = sorted("|".join(normal(dict(zip(columns, r, strict=True))[c]) for c in names) for r in out.fetchall())
    assert got == want
