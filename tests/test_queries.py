"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from attestry.plans import registry
from parity import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    text, ok, _ = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, text
