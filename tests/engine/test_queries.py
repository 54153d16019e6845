"""Every query with SQL equals DuckDB's result; the others have rows and a stable schema."""

import math

import duckdb
import pytest

from quern import evaluation_queries as engine

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    df = engine.QUERIES[name](spark, sf_dir)
    found = con.execute(engine.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, found.fetchall())


def test_every_query_has_sql():
    assert set(engine.QUERIES) == set(engine.ORACLES)


@pytest.mark.parametrize("name", ["learner_uncertainty", "learner_policy_table"])
def test_estimates_lie_within_their_intervals(spark, name):
    found = engine.QUERIES[name](spark, "/root/testdata/sf0.01")
    if name == "learner_uncertainty":
        own = found.where("metric in ('auuc', 'qini') or metric rlike '^gain_at_[0-9]+pct$'")
        assert own.count() > 40 and own.where("estimate < ci_lower or estimate > ci_upper").isEmpty()
    else:
        own = found.where("incremental_gain_ci_lower is not null")
        assert own.count() > 20 and own.where("cumulative_gain < incremental_gain_ci_lower or cumulative_gain > incremental_gain_ci_upper").isEmpty()
