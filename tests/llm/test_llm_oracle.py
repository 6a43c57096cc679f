"""Every query of the subpackage with SQL against DuckDB on the smaller tables."""

import glob
import os

import duckdb
import pytest

from rankweave.llm import registry

ROOT = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.01"), reason="the driver's tables are not here")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name, scale):
    duck = duckdb.connect()
    for p in glob.glob(f"{ROOT}/{scale}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = registry.queries()[name](spark, f"{ROOT}/{scale}")
    want = duck.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall())
