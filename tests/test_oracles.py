"""Every query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import difference, kinds

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", ["inventory_report", "verification_report", "audit_parsed"])
def test_same_types(spark, name):
    assert kinds(spark, QUERIES[name], ORACLES[name], SF_DIR) == {}


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
