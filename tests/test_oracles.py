"""Every query with SQL, compared with DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check  # noqa: E402
from voxloom.queries.registry import REGISTRY  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WITH_SQL = [name for name, query in REGISTRY.items() if query.sql is not None]


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, duck, name):
    query = REGISTRY[name]
    ok, note, _took = check.compare(spark, duck, query.run, query.sql, SMALL)
    assert ok, note
