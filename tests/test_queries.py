"""Every core query against its SQL in DuckDB, over the smallest data."""

import math
import os

import pytest
from pyspark.sql import functions as F

import loomgraph.plans.registry as registry
from loomgraph.operators import traverse

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, cols, data):
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = rows(df.columns, cols, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == rows(names, cols, r.fetchall())


def test_streamed_commits_equal_the_batch(spark):
    stream = {r.relation: r.provenances for r in registry.queries()["streamed_commits"](spark, DATA).collect()}
    batch = registry.queries()["edge_provenance_counts"](spark, DATA).groupBy("relation").sum("provenances").collect()
    assert stream == {r.relation: r[1] for r in batch}


def test_hard_chunks_are_the_hard_ones_and_a_few_more(spark):
    flags = {r.key: r.hard for r in registry.queries()["hard_chunk_flags"](spark, DATA).collect()}
    got = {r.key: r for r in registry.queries()["hard_chunks"](spark, DATA).collect()}
    picked = {k for k, r in got.items() if r.escalate} if "escalate" in next(iter(got.values())).asDict() else set(got)
    hard = {k for k, v in flags.items() if v}
    assert hard <= picked and len(picked - hard) <= 0.15 * (len(flags) - len(hard)) + 3


def most_golds(spark, monkeypatch, name):
    """The most golds that a question brings into the traversal."""
    seen, real = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: seen.append(real(df)) or seen[-1])
    registry.queries()[name](spark, DATA).count()
    return max(df.agg(F.max(F.size("golds"))).first()[0] or 0 for df in seen if {"question", "golds"} <= set(df.columns))


def test_shaped_rollouts_carry_no_golds(spark, monkeypatch):
    assert most_golds(spark, monkeypatch, "shaped_rollouts") == 0  # before, the lists of all golds


def test_trajectory_rewards_carry_no_golds(spark, monkeypatch):
    assert most_golds(spark, monkeypatch, "trajectory_rewards") == 0  # before, the lists of all golds
