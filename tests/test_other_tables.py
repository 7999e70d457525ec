"""Queries against their SQL on tables other than the driver's: without the document they name, and with several of its name."""

import os

import pytest
from pyspark.sql import functions as F

from corpusq import errors
from corpusq.operators import counts
from corpusq.queries import corpus_queries
from tests.oracle import DATA, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAME = "bitter_basket_000008.en.conllu"
QUERIES = ("q_count_in_document", "q_document_by_stem", "q_vocabulary_of_document")


def tables(spark, folder, doc_name):
    """The tables with other names of documents, and DuckDB over them."""
    import duckdb

    db = duckdb.connect()
    for t in os.listdir(DATA):
        if t != "corpus_docs.parquet":
            os.symlink(f"{DATA}/{t}", folder / t)
    spark.read.parquet(f"{DATA}/corpus_docs.parquet").withColumn("doc_name", doc_name).write.parquet(str(folder / "corpus_docs.parquet"))
    for t in os.listdir(folder):
        p = folder / t
        db.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return str(folder), db


@pytest.fixture(scope="module")
def absent(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("absent"), F.concat(F.lit("other_"), "doc_name"))


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("repeated"), F.when(F.col("doc_in_comp") == 0, NAME).otherwise(F.col("doc_name")))


def both(spark, name, folder, db):
    df, cur = corpus_queries.QUERIES[name](spark, folder), db.execute(corpus_queries.SQL[name])
    wanted = rows_of([d[0] for d in cur.description], cur.fetchall())
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), wanted


@pytest.mark.parametrize("name", QUERIES)
def test_no_document_of_that_name(spark, absent, name):
    got, wanted = both(spark, name, *absent)
    assert got == wanted == []


@pytest.mark.parametrize("name", QUERIES)
def test_several_documents_of_that_name(spark, repeated, name):
    got, wanted = both(spark, name, *repeated)
    assert got == wanted and len(got) > 1


def test_an_unknown_document_stays_an_error_where_one_is_asked_for(spark, absent):
    c = corpus_queries.corpus(spark, absent[0])
    with pytest.raises(errors.NotFound):
        counts.count_by_document(c, "[]", document=NAME)
