"""Every registered query against its SQL, on the smallest data."""

import os

import pytest
from oracle import connect, difference

import __spark_entry__ as contract
from lotwise import catalogue

SF_DIR = os.environ.get("LOTWISE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(
    not os.path.isdir(SF_DIR), reason="test tables not present"
)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    assert difference(df, con, catalogue.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "draw_id" and df.count() == 2000
