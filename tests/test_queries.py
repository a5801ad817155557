"""Every query of the derived tables against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ordinex.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(v, 8) + 0.0 if isinstance(v, float) else v
    return sorted(repr([clean(v[k]) for k in order]) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_bootstraps_run_the_repetitions_that_are_said(spark, monkeypatch):
    from ordinex.operators import resampling
    from ordinex.plans import tables

    asked, own = [], resampling.resampled
    monkeypatch.setattr(resampling, "resampled", lambda *a, **k: asked.append(a[6]) or own(*a, **k))
    for name in (n for n in QUERIES if n.startswith("bootstrap_")):
        QUERIES[name](spark, SF)
    assert (tables.UNITS_DRAWN, tables.TRIALS_DRAWN) == (2000, 200) and set(asked) == {2000, 200} and asked.count(2000) == 4


def test_no_query_is_empty(spark, duck):
    for name in ("exclusion_antijoin", "outcome_violations", "registry_violations", "matrix_violations", "set_overlaps"):
        assert duck.sql(ORACLES[name]).fetchall()
