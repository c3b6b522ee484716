"""Every query of the library against its DuckDB oracle (sf0.001), and the
rows-only queries for a stable, non-empty schema."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from labelforge.plans.registry import ORACLES, QUERIES, load_all
from labelforge.session import ship_package
from oracle_harness import compare, duck

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_matches(spark, con, name):
    r = compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SMALL)
    first = df.schema
    rows = df.collect()
    assert df.schema == first
    assert len(rows) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["subject_id", "study_id", "findings", "impression", "label", "explanation", "confidence"]
    assert df.count() > 0
