"""Queries over decisions equal their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from oppflow.plans import decisions
from oppflow.plans.queries import ORACLE_SQL, QUERIES

NAMES = [n for n, f in QUERIES.items() if f.__module__ == decisions.__name__ and n != "upsert_snapshot"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(cols).collect()), key=repr)
    said = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    rows = sorted((tuple(r[names.index(c)] for c in cols) for r in said.fetchall()), key=repr)
    assert got and got == rows
