"""Recall and precision of alignment, look-alikes and content scores: python -m tests.llm.quality FOLDER [p1 p6 p9]."""

import random
import sys
import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusq.llm import abuse, align, lookalikes, queries
from corpusq.operators.latest import latest_valid
from corpusq.queries.core_problems import table, tokens
from tests.llm.test_pairs_packs_mixes import TOK, bilingual


def report(name, found, true):
    print(f"{name}: {len(true)} true, {len(found)} found, recall {len(found & true) / max(1, len(true)):.4f}, precision {len(found & true) / max(1, len(found)):.4f}", flush=True)


def p1(spark, d):
    """On document pairs with hand-made edges, without adding these; then on made documents."""
    docs, meta = latest_valid(table(spark, d, "corpus_docs"), "doc_idx"), table(spark, d, "alignment_meta")
    t = tokens(spark, d, "doc_idx", "sent_idx", "sent_in_doc", "word", "lemma", "upos")
    found = {tuple(r[:3]) for r in align.align_sentences(t, docs, meta).collect()}
    sents = latest_valid(table(spark, d, "sentences").select("sent_idx", "sent_in_doc", "doc_idx", "ingested_at"), "sent_idx")
    given = {tuple(r) for r in align.hand_made(table(spark, d, "alignment_edges"), docs, sents, align.document_pairs(docs, meta)).collect()}
    of = {r.sent_idx: r.doc_idx for r in sents.collect()}
    pairs = {(n, of[a], of[b]) for n, a, b in given}
    report("p1, hand-made edges", {x for x in found if (x[0], of[x[1]], of[x[2]]) in pairs}, given)
    for title, n_docs, n_sent, names, own in (("documents of 1,300 sentences", 3, 1300, True, align.OWN_ROWS), ("no shared strings", 60, 12, False, align.OWN_ROWS), ("shared rows only", 12, 40, True, 1)):
        tok, made, true = bilingual(random.Random(5), n_docs, n_sent, names)
        align.OWN_ROWS, kept = own, align.OWN_ROWS
        m = spark.createDataFrame([("s", "es", "en")], "align_name string, source_component string, target_component string")
        got = align.align_sentences(spark.createDataFrame(tok, TOK), spark.createDataFrame(made, "doc_idx int, doc_in_comp int, comp string, pair_key string"), m).collect()
        align.OWN_ROWS = kept
        report(f"p1, {title}", {(r.sent_a, r.sent_b) for r in got}, true)


def p6(spark, d):
    """Plain spellings of the table, disguised by look-alikes, widths, accents taken apart and invisible characters."""
    rng = random.Random(1)
    looks = {}
    for c, latin in lookalikes.LOOKS_LATIN.items():
        looks.setdefault(latin[0], []).append(c)
    words = sorted(r.word for r in tokens(spark, d, "word").groupBy("word").count().where(f"word RLIKE '{lookalikes.PLAIN}' AND length(word) > 3").collect())

    def disguise(w):
        kind, i = rng.randrange(4), rng.randrange(1, len(w))
        if kind == 0 and any(c in looks for c in w[1:]):
            i = rng.choice([i for i, c in enumerate(w) if c in looks and i])
            return w[:i] + rng.choice(looks[w[i]]) + w[i + 1 :]
        if kind == 1 and all("!" <= c <= "~" for c in w):
            return "".join(chr(ord(c) + 0xFEE0) for c in w)
        return unicodedata.normalize("NFD", w) if kind == 2 and not w.isascii() else w[:i] + rng.choice("​﻿­⁠") + w[i:]

    true = {(disguise(w), w) for w in words}
    rows = [("x", w, 5) for w in words] + [("x", x, 1) for x, _ in true]
    got = lookalikes.canonical_table(spark.createDataFrame(rows, "comp string, term string, n long")).collect()
    report("p6, disguised spellings", {(r.term, r.canonical) for r in got}, true)


def p9(spark, d):
    """Judged documents in five parts, each scored by the other four; wrong judgements count as they are."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), abuse.majority(table(spark, d, "doc_labels"))
    rows = docs.where("text IS NOT NULL").join(labels, "doc_id").orderBy("doc_id").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5))).collect()
    found = set()
    for k in range(5):
        w = abuse.fit([r.text for r in rows if r.part != k], [r.y for r in rows if r.part != k])
        held = [r for r in rows if r.part == k]
        found |= {r.doc_id for r, s in zip(held, abuse.document_scores(w, [r.text for r in held]), strict=True) if s >= queries.ABUSE_THRESHOLD}
    report("p9, held-out judgements", found, {r.doc_id for r in rows if r.y})
    whole = abuse.train(docs, table(spark, d, "doc_labels"))
    found = {r.doc_id for r in abuse.score_documents(docs, whole).where(F.col("score") >= queries.ABUSE_THRESHOLD).select("doc_id").collect()}
    larger = "/root/testdata/check_l"
    better = abuse.train(table(spark, larger, "documents").select("doc_id", "text"), table(spark, larger, "doc_labels"))
    true = {r.doc_id for r in abuse.score_documents(docs, better).where(F.col("score") >= queries.ABUSE_THRESHOLD).select("doc_id").collect()}
    report("p9, all documents, against a fit on ten times the judgements", found, true)


if __name__ == "__main__":
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or ["p1", "p6", "p9"]:
        globals()[name](s, sys.argv[1])
