"""Every query that has SQL against DuckDB over the same tables, at the smallest scale."""

import os

import duckdb
import pytest

from courtflow.plans import more  # noqa: F401 - adds its queries
from courtflow.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(frame.astype(object).where(frame.notna(), None).apply(tuple, axis=1).tolist(), key=repr) if len(frame) else []


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
