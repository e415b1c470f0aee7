"""Every registered query runs over whole tables and agrees with its SQL; names and columns are in order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import plain
from tilefold.plans import registry


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, con, name):
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = con.sql(sql)
        names = list(rel.columns)
        assert sorted(names) == cols
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(any(n == f"p{k}_found" for n in names) for k in range(1, 6))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
