"""Every query that has SQL gives what DuckDB gives on the small tables; the others give rows."""

import os
from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted([value(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = table([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLES:
        said = db.execute(catalog.ORACLES[name])
        assert got == table(said.fetchall(), [d[0] for d in said.description])
    else:
        assert df.columns


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
