"""The registered training-data queries over their whole tables (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from labelforge.llm import queries
from oracle_harness import compare, duck

ALL, SQL = E.queries(), E.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle_matches(spark, name):
    r = compare(spark, duck(SMALL), SMALL, name, ALL[name], SQL[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)) + ["pipeline"])
def test_rows(spark, name):
    df = ALL[name](spark, SMALL)
    assert len(df.collect()) > 0 and name not in SQL


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
