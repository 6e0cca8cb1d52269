"""Every registered query of the library's own operators against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from sedge.plans import registry

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["windows_ordered", "windows_ranks", "slice_tail_grouped", "grouped_filter_max"])
def test_query_by_blocks(spark, duck, name, monkeypatch):
    monkeypatch.setattr("sedge.operators.frame.SMALL_FRAME", -1)
    monkeypatch.setattr("sedge.operators.frame.LARGEST_GROUP", 0)
    test_query(spark, duck, name)
