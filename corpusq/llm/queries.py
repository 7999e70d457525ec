"""Queries over the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import abuse, align, burst_trie, lookalikes, mixing, packing
from corpusq.llm.sizes import with_sizes
from corpusq.functions.storage import written
from corpusq.operators.latest import latest_valid
from corpusq.queries.core_problems import _VALID, POSITION_BLOCK, table, tokens

#: A document is reported from this score of its worst passage on.
ABUSE_THRESHOLD = 0.3


def _layers(t: DataFrame, *names: str) -> DataFrame:
    return t.select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("term")) for x in names])).alias("v")).select("*", "v.*").drop("v", *names)


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of word, lemma and upos: positions, corpus documents holding it, verdict."""
    n_docs = table(spark, sf_dir, "corpus_docs").select(F.count_distinct("doc_idx")).first()[0]
    names = "word", "lemma", "upos"
    values = _layers(tokens(spark, sf_dir, "doc_idx", *names), *names).drop("pos")
    counts = burst_trie.term_frequencies(values, "doc_idx", _layers(table(spark, sf_dir, "tokens").select(*names), *names))
    return burst_trie.verdicts(counts, n_docs).withColumnRenamed("n_records", "n_docs")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("verdict IS NOT NULL").select("layer", "term", "verdict")


def _vocabulary(t: DataFrame) -> DataFrame:
    return _layers(t.groupBy("comp", "word", "lemma").agg(F.count(F.lit(1)).alias("n")), "word", "lemma").groupBy("comp", "term").agg(F.sum("n").alias("n"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir, "comp", "word", "lemma")
    vocabulary = written(_vocabulary(t), "vocabulary")
    scripts = lookalikes.alphabets(vocabulary)
    forms = lookalikes.canonical_table(vocabulary, scripts=scripts).select(F.col("comp").alias("c"), F.col("term").alias("t"))
    odd = lambda x: lookalikes.suspect(x, "comp", scripts)
    met = _layers(t.where(odd("word") | odd("lemma")), "word", "lemma").where(odd("term"))
    return met.join(forms, F.expr("term = t AND comp <=> c"), "left_semi").select("pos", "layer")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct string of each component with its number of positions and its consistent form."""
    return lookalikes.canonical_forms(written(_vocabulary(tokens(spark, sf_dir, "comp", "word", "lemma")), "vocabulary"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each piece of one, for every capacity."""
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the number that no packing goes below, the gap between them, tokens, unused share."""
    sizes = written(_sizes(spark, sf_dir), "sizes")
    specs = table(spark, sf_dir, "pack_specs")
    least = packing.lower_bounds(packing.items_of(sizes, specs))
    bound = spark.createDataFrame(list(least.items()), "spec_name string, lower_bound bigint")
    used = packing.pack(sizes, specs).groupBy("spec_name", "capacity", "container").agg(F.sum("n_tokens").alias("used"), F.min("certified").alias("certified"))
    per = used.groupBy("spec_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.count_if("certified").alias("n_certified"))
    return per.join(bound, "spec_name").withColumns({"gap": F.col("n_containers") - F.col("lower_bound"), "unused_share": 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))})


def _mix(spark: SparkSession, sf_dir: str) -> tuple:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each mix."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: targets and what is reached."""
    return mixing.shares(*_mix(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    weights = abuse.train(docs, table(spark, sf_dir, "doc_labels"))
    return abuse.score_documents(docs, weights).select("doc_id", "source", "score")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= ABUSE_THRESHOLD).select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, those reported and their rate; documents without source under NULL."""
    hit = (F.col("score") >= ABUSE_THRESHOLD).cast("bigint")
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_found"), (F.sum(hit) / F.count(F.lit(1))).alias("rate"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latest_valid(table(spark, sf_dir, "corpus_docs"), "doc_idx")
    meta = table(spark, sf_dir, "alignment_meta")
    found = align.align_sentences(tokens(spark, sf_dir, "doc_idx", "sent_idx", "sent_in_doc", "word", "lemma", "upos"), docs, meta)
    sentences = latest_valid(table(spark, sf_dir, "sentences").select("sent_idx", "sent_in_doc", "doc_idx", "ingested_at"), "sent_idx", block=POSITION_BLOCK)
    given = align.hand_made(table(spark, sf_dir, "alignment_edges"), docs, sentences, align.document_pairs(docs, meta))
    return found.unionByName(given.withColumn("similarity", F.lit(None).cast("double"))).groupBy("align_name", "sent_a", "sent_b").agg(F.max("similarity").alias("similarity"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select(F.least("sent_a", "sent_b").alias("sent_idx_a"), F.greatest("sent_a", "sent_b").alias("sent_idx_b")).distinct()


def p1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as edges: source and target sentence of each alignment; similarity is NULL for edges only given by hand."""
    return _aligned(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_edges": p1_edges, "p5_found": p5_found, "p5_terms": p5_terms, "p6_found": p6_found, "p6_forms": p6_forms, "p7_pack": p7_pack, "p7_report": p7_report, "p8_draws": p8_draws, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores, "p9_sources": p9_sources}

_TERMS = f"""WITH valid AS (SELECT * FROM {_VALID}), v AS (SELECT 'word' AS layer, word AS term, doc_idx FROM valid UNION ALL SELECT 'lemma', lemma, doc_idx FROM valid UNION ALL SELECT 'upos', upos, doc_idx FROM valid),
counts AS (SELECT layer, term, count(*) AS n_positions, count(DISTINCT doc_idx) AS n_docs FROM v WHERE term IS NOT NULL GROUP BY ALL),
marked AS (SELECT *, CASE WHEN n_positions <= 2 THEN 'rare' WHEN n_docs * 3 > (SELECT count(DISTINCT doc_idx) FROM corpus_docs) THEN 'common' END AS verdict FROM counts)"""
SQL = {
    "p5_terms": f"{_TERMS} SELECT * FROM marked",
    "p5_found": f"{_TERMS} SELECT layer, term, verdict FROM marked WHERE verdict IS NOT NULL",
}
