"""Every registered query against its SQL counterpart, at the smallest scale."""

import os

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    problems, rows, *_ = compare.differences(spark, con, SF, name, queries()[name], oracle_sql()[name])
    assert not problems, problems
    assert rows > 0


def test_entry(spark):
    assert entry(spark).columns == ["conv_id", "prompt", "n_slots"]
