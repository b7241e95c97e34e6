"""Every query of the llm problems runs on the smallest data, and equals its SQL where it has one."""

import os

import pytest

from tests.test_queries import FOLDER, plain, sql  # noqa: F401
from tidemark.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):  # noqa: F811
    got, want = QUERIES[name](spark, FOLDER).toPandas(), sql.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
