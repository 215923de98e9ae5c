"""The data-quality report of one scan: every section has the rows of the query that scans for it alone."""

import os

import duckdb
import pytest

from tests.test_oracles import SF, plain
from tracemill import registry
from tracemill.operators import quality
from tracemill.plans.package_plans import SECTIONS
from tracemill.sources.views import view


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def made(spark):
    return quality.analyze(view(spark, SF, "logs"))


@pytest.mark.parametrize("name", SECTIONS)
def test_section(made, duck, name):
    df = made[name]
    cols = sorted(df.columns)
    rel = duck.execute(registry.ORACLES[SECTIONS[name]])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_all_sections_have_a_query():
    assert set(SECTIONS) == set(quality.SECTIONS)


def test_sections_read_the_counts_and_not_the_records(made):
    for df in made.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "event_id" not in plan  # the records' own table


def test_an_empty_table(spark):
    empty = quality.analyze(view(spark, SF, "logs").limit(0))
    assert empty["population"].count() == 0 and [tuple(r) for r in empty["time_stats"].collect()] == [(0, 0, None, None, None, 0)]
    assert empty["session_sizes"].first()["sessions"] == 0 and empty["numeric_semantics"].first()["zeros"] == 0
