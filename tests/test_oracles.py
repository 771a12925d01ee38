"""Every query against its DuckDB oracle on the smallest tables."""

import datetime

import duckdb
import pytest

from ledgerlens.plans.catalog import load_all
from ledgerlens.session import TABLES

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return ("float", round(v, 9))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_needs_no_optional_parts(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_has", lambda name: False)
    names = entry.queries()
    assert set(names) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES) <= set(names)
