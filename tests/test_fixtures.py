"""Operators on small fixtures."""

import duckdb
import pytest

from tests import fixture_cases


@pytest.mark.parametrize("name", sorted(fixture_cases.QUERIES))
def test_fixture(spark, name):
    answer = duckdb.connect().execute(fixture_cases.ORACLES[name])
    columns = [x[0] for x in answer.description]
    got = fixture_cases.QUERIES[name](spark, "").select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, answer.fetchall()))
