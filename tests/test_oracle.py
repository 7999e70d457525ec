import os

import pytest

from corpusq.queries import core_problems, corpus_queries
from tests.oracle import DATA, database, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = core_problems.QUERIES | corpus_queries.QUERIES
SQL = core_problems.SQL | corpus_queries.SQL


@pytest.fixture(scope="module")
def db():
    return database()


def test_every_query_has_sql():
    assert not QUERIES.keys() - SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    same(spark, QUERIES[name], db, SQL[name])


def test_pairs_of_all_components(spark):
    got = core_problems.QUERIES["p3_all_pairs"](spark, DATA).collect()
    comps = {r.comp for r in core_problems.table(spark, DATA, "components").collect()}
    assert {(r.comp, r.other_comp) for r in got} == {(a, b) for a in comps for b in comps if a != b}
    some = {(r.upos, r.other_upos, r.n_pairs) for r in got if (r.comp, r.other_comp) == ("fr", "es")}
    assert some == {tuple(r) for r in core_problems.p3_pairs(spark, DATA).select("upos", "upos_es", "n_pairs").collect()}


def test_every_key_of_feats_has_a_layer(spark):
    layers = {r.layer for r in QUERIES["q_distinct_counts_all"](spark, DATA).collect()}
    assert {f"feats.{k}" for k in ("Number", "Tense", "Gender", "Person", "Mood")} <= layers
    assert QUERIES["q_feature_gender"](spark, DATA).count() > 0
