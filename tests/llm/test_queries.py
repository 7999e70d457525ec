import os

import pytest

from corpusq.llm import queries
from tests.oracle import DATA, database, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    same(spark, queries.QUERIES[name], database(), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns and (df.count() > 0 or name == "p9_found")  # the smallest table has too few judgements
