"""Every registered query against its DuckDB oracle on the test tables.

Runs at sf0.001 by default; set LEARNLENS_TEST_SF=/root/testdata/sf0.01 for
the driver's correctness scale.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from compare import compare, duck
from learnlens import oracle, registry

SF = os.environ.get("LEARNLENS_TEST_SF", "/root/testdata/sf0.001")
QUERIES = registry.QUERIES
SQL = oracle.sql()


@pytest.fixture(scope="module")
def con():
    c = duck(SF)
    yield c
    c.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    result = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert result["ok"], result


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "avg_score" in df.columns


SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, con, name):
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in QUERIES[name](spark, SF).dtypes}
    rel = con.sql(SQL[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
