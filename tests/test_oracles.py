"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from evtlake.surrogate.registry import ORACLES, QUERIES
from tests.oracle_check import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    outcome, rows, _ = compare(spark, name, "/root/testdata/sf0.001", QUERIES, ORACLES)
    assert outcome == "ok"
    assert rows > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
