"""Every registered query beside its SQL twin in DuckDB, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from spanloom.plans import queries, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(value):
    """Values as text; whole floats and integers alike."""
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return f"{value:.9g}" if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 10**8 else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted([text(r[c]) for c in columns] for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = sorted([text(r[k]) for k in at] for r in want.fetchall())
    assert len(a) == len(b)
    assert a == b
