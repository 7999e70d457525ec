"""The engine's operators over the driver's tables, each with an independent SQL formulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.functions import files
from corpusq.functions.storage import new_path
from corpusq.model import CORE_LAYERS, Corpus, from_deliveries, kept
from corpusq.operators import counts, navigation, text
from corpusq.operators.paging import page, ranked
from corpusq.plans.compiler import Options, captures, run
from corpusq.session import Results
from corpusq.sources import store
from corpusq.sources.build import assemble, build_directory
from corpusq.sources.readers import ConlluReader, PlainTextReader

#: Keys of feats that the SQL of q_distinct_counts has; the corpus has a layer for every key.
FEATURES = ("Number", "Tense")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS rn FROM {table}) WHERE rn = 1"
_WITH = f"WITH RECURSIVE t AS ({_LATEST.format(key='pos', table='tokens')}), s AS ({_LATEST.format(key='sent_idx', table='sentences')}), d AS ({_LATEST.format(key='doc_idx', table='corpus_docs')})"


#: Corpora that were stored and opened stand for the tables they were made of.
OPEN: dict[str, Corpus] = {}
_KEPT: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Made of the deliveries once per application and version of the tables."""
    if sf_dir in OPEN:
        return OPEN[sf_dir]
    key = spark.sparkContext.applicationId, sf_dir, *[files.version(spark, f"{sf_dir}/{t}.parquet") for t in ("tokens", "sentences", "corpus_docs")]
    if key not in _KEPT:
        _KEPT[key] = kept(from_deliveries(spark, sf_dir, None))
    return _KEPT[key]


def _add(name: str, query: Callable[[Corpus], DataFrame], sql: str | None = None, more: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: query(corpus(spark, sf_dir))
    if sql is not None:
        SQL[name] = f"{_WITH}{', ' + more if more else ''} {sql}"


def _cql(name: str, query: str, sql: str, more: str = "", **options) -> None:
    """Hits as start_pos, end_pos and captures."""

    def spans(c: Corpus) -> DataFrame:
        h = run(c, query, **options)
        return h.select("start_pos", "end_pos", *[f"cap_{x}_{e}" for x in captures(h) for e in ("start", "end")])

    _add(name, spans, sql, more)


def _run_of(name: str, test: str) -> str:
    """Token by token: all stretches of up to 100 tokens that meet a test, within a document."""
    return f"""{name}_m AS (SELECT pos, doc_idx FROM t WHERE {test}),
{name} AS (SELECT pos AS a, pos + 1 AS b, doc_idx FROM {name}_m UNION ALL SELECT r.a, r.b + 1, r.doc_idx FROM {name} r JOIN {name}_m m ON m.pos = r.b AND m.doc_idx = r.doc_idx WHERE r.b - r.a < 100)"""


_S, _ONE = "SELECT pos AS start_pos, pos + 1 AS end_pos FROM t", "a.pos AS start_pos"
_NOUN, _ADJ, _DET, _ADV = ("upos = '{}'".format(x) for x in ("NOUN", "ADJ", "DET", "ADV"))

# token tests
_cql("q_literal", '[pos="NOUN"]', f"{_S} WHERE upos = 'NOUN'")
_cql("q_word", '"garden"', f"{_S} WHERE word = 'garden'")
_cql("q_regex", "[word=/^[A-Z].*s$/]", f"{_S} WHERE regexp_matches(word, '^[A-Z].*s$')")
_cql("q_negation", '[pos!="PUNCT"]', f"{_S} WHERE upos IS DISTINCT FROM 'PUNCT'")
_cql("q_conjunction", '[pos="NOUN" & lemma!="garden" & xpos=/^NNS$/ & deprel!=/^ob/]', f"{_S} WHERE upos = 'NOUN' AND lemma IS DISTINCT FROM 'garden' AND xpos = 'NNS' AND NOT coalesce(regexp_matches(deprel, '^ob'), false)")
_cql("q_feature_layer", '[feats.Number="Plur" & feats.Tense!="Past"] [feats.Tense="Past"]', """SELECT a.pos AS start_pos, a.pos + 2 AS end_pos FROM t a JOIN t b ON b.pos = a.pos + 1
WHERE list_contains(string_split(a.feats, '|'), 'Number=Plur') AND NOT coalesce(list_contains(string_split(a.feats, '|'), 'Tense=Past'), false) AND list_contains(string_split(b.feats, '|'), 'Tense=Past')""")
_cql("q_feature_gender", '[feats.Gender="Fem"]', f"{_S} WHERE list_contains(string_split(feats, '|'), 'Gender=Fem')")
_cql("q_unindexed_layer", '[head="1"] | [deps!="x" & lemma="garden"]', f"{_S} WHERE lemma = 'garden'")
# sequences
_cql("q_sequence", '[pos="ADJ"] [pos="NOUN"]', f"SELECT {_ONE}, a.pos + 2 AS end_pos FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_ADJ} AND b.{_NOUN}")
_cql("q_sequence_crossing", '[pos="PUNCT"] [pos="DET"] [pos="NOUN"]', f"SELECT {_ONE}, a.pos + 3 AS end_pos FROM t a JOIN t b ON b.pos = a.pos + 1 JOIN t c ON c.pos = a.pos + 2 WHERE a.upos = 'PUNCT' AND b.{_DET} AND c.{_NOUN}")
_cql("q_sequence_apart", '[pos="PUNCT"] [pos!="PUNCT"]', f"SELECT {_ONE}, a.pos + 2 AS end_pos FROM t a JOIN t b ON b.pos = a.pos + 1 AND b.doc_idx = a.doc_idx WHERE a.upos = 'PUNCT' AND b.upos IS DISTINCT FROM 'PUNCT'")
_cql("q_any_between", '[pos="DET"] [] [pos="NOUN"] within s', f"SELECT {_ONE}, a.pos + 3 AS end_pos FROM t a JOIN t b ON b.pos = a.pos + 2 AND b.doc_idx = a.doc_idx WHERE a.{_DET} AND b.{_NOUN} AND a.pos + 3 <= a.sent_end")
_cql("q_plus", '[pos="ADJ"]+', "SELECT a AS start_pos, b AS end_pos FROM r", _run_of("r", _ADJ))
_cql("q_between", '([pos="DET"] | [pos="ADJ"] | [pos="NOUN"]){2,4}', "SELECT a AS start_pos, b AS end_pos FROM r WHERE b - a BETWEEN 2 AND 4", _run_of("r", "upos IN ('DET', 'ADJ', 'NOUN')"))
_cql("q_star", '[pos="DET"] [pos="ADJ"]* [pos="NOUN"] within s', f"""SELECT DISTINCT a.pos AS start_pos, n.pos + 1 AS end_pos FROM t a LEFT JOIN r ON r.a = a.pos + 1 AND r.doc_idx = a.doc_idx
JOIN t n ON n.doc_idx = a.doc_idx AND (n.pos = r.b OR n.pos = a.pos + 1) WHERE a.{_DET} AND n.{_NOUN} AND n.pos < a.sent_end""", _run_of("r", _ADJ))
_SET, _BOTH = "upos IN ('DET', 'ADJ', 'NOUN')", '[pos="ADV"]? [pos=/^(DET|ADJ|NOUN)$/]'
_OPTIONAL = f"SELECT r.pos AS start_pos, n.pos + 1 AS end_pos FROM t r JOIN t n ON n.pos = r.pos + 1 AND n.doc_idx = r.doc_idx WHERE r.{_ADV} AND n.{_SET}"
_cql("q_optional_first", _BOTH, f"{_OPTIONAL} UNION SELECT n.pos, n.pos + 1 FROM t n LEFT JOIN t p ON p.pos = n.pos - 1 AND p.doc_idx = n.doc_idx AND p.{_SET} WHERE n.{_SET} AND p.pos IS NULL")
_cql("q_optional_first_standard", _BOTH, f"{_OPTIONAL} UNION SELECT pos, pos + 1 FROM t WHERE {_SET}", options=Options("standard"))
_cql("q_gap", '[lemma="garden"] []{1,3} [pos="VERB"]', "SELECT a.pos AS start_pos, b.pos + 1 AS end_pos FROM t a JOIN t b ON b.doc_idx = a.doc_idx AND b.pos BETWEEN a.pos + 2 AND a.pos + 4 WHERE a.lemma = 'garden' AND b.upos = 'VERB'")
_cql("q_open_gap", '[lemma="merchant"] []* [lemma="river"] within s', "SELECT a.pos AS start_pos, b.pos + 1 AS end_pos FROM t a JOIN t b ON b.doc_idx = a.doc_idx AND b.pos BETWEEN a.pos + 1 AND a.pos + 101 WHERE a.lemma = 'merchant' AND b.lemma = 'river' AND b.pos < a.sent_end")
# alternatives and groups
_cql("q_alternatives", '[pos="ADV"] | [pos="ADJ"] | "and"', f"{_S} WHERE upos IN ('ADV', 'ADJ') OR word = 'and'")
_cql("q_alternative_sequences", '[pos="ADJ"] [pos="ADJ"] | [pos="SCONJ"]', f"SELECT a.pos AS start_pos, a.pos + 1 AS end_pos FROM t a LEFT JOIN t b ON b.pos = a.pos + 1 WHERE a.upos = 'SCONJ' OR (a.{_ADJ} AND b.{_ADJ})")
_cql("q_alternative_runs", '([pos="ADJ"] | [pos="DET"])+ [pos="NOUN"]', f"SELECT r.a AS start_pos, n.pos + 1 AS end_pos FROM r JOIN t n ON n.pos = r.b AND n.doc_idx = r.doc_idx WHERE n.{_NOUN}", _run_of("r", "upos IN ('ADJ', 'DET')"))
_cql("q_group", '([pos="DET"] [pos="NOUN"]) [pos="NOUN"]', f"SELECT {_ONE}, a.pos + 2 AS end_pos FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_DET} AND b.{_NOUN}")
# labels and conditions
_cql("q_labels", 'a:[pos="DET"] b:[pos="NOUN"]', f"SELECT {_ONE}, a.pos + 2 AS end_pos, a.pos AS cap_a_start, a.pos + 1 AS cap_a_end, b.pos AS cap_b_start, b.pos + 1 AS cap_b_end FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_DET} AND b.{_NOUN}")
_cql("q_label_run", 'a:[pos="DET"]+ [pos="NOUN"]', f"SELECT r.a AS start_pos, n.pos + 1 AS end_pos, r.a AS cap_a_start, r.b AS cap_a_end FROM r JOIN t n ON n.pos = r.b AND n.doc_idx = r.doc_idx WHERE n.{_NOUN}", _run_of("r", _DET))
_PAIR = "SELECT a.pos AS start_pos, b.pos + 1 AS end_pos, a.pos AS cap_a_start, a.pos + 1 AS cap_a_end, b.pos AS cap_b_start, b.pos + 1 AS cap_b_end FROM t a JOIN t b ON b.doc_idx = a.doc_idx"
_cql("q_same", 'a:[pos="NOUN"] []{1,4} b:[pos="NOUN"] within s :: a.lemma = b.lemma', f"{_PAIR} AND b.pos BETWEEN a.pos + 2 AND a.pos + 5 WHERE a.{_NOUN} AND b.{_NOUN} AND b.pos < a.sent_end AND a.lemma = b.lemma")
_cql("q_different", 'a:[pos="DET"] []{0,1} b:[pos="NOUN"] within s :: a.feats != b.feats & a.xpos != b.deprel', f"{_PAIR} AND b.pos BETWEEN a.pos + 1 AND a.pos + 2 WHERE a.{_DET} AND b.{_NOUN} AND b.pos < a.sent_end AND a.feats <> b.feats AND a.xpos <> b.deprel")
_cql("q_distance", 'a:[pos="VERB"] []{0,5} b:[lemma="garden"] :: distance(a,b) >= 3 & distance(b,a) = 0', f"{_PAIR} AND b.pos BETWEEN a.pos + 4 AND a.pos + 6 WHERE a.upos = 'VERB' AND b.lemma = 'garden'")
# filters and projection
_cql("q_within_component", '[pos="ADJ"] within component:fr,"es",nowhere', f"{_S} WHERE upos = 'ADJ' AND comp IN ('fr', 'es')")
_cql("q_within_document", '[pos="NOUN"] within doc:"bitter_basket_000008.en.conllu"', f"{_S} WHERE upos = 'NOUN' AND doc_idx IN (SELECT doc_idx FROM d WHERE doc_name = 'bitter_basket_000008.en.conllu')")
_cql("q_within_unknown_layer", '[pos="SCONJ"] within stanza', f"{_S} WHERE upos = 'SCONJ'")
_TARGETS = """JOIN s ss USING (sent_idx) JOIN d sd ON sd.doc_idx = h.doc_idx JOIN alignment_edges e ON e.align_name = 'sentence' AND e.src_doc = sd.doc_in_comp AND e.src_sent = ss.sent_in_doc
JOIN d td ON td.comp = 'en' AND td.doc_in_comp = e.tgt_doc JOIN s ts ON ts.doc_idx = td.doc_idx AND ts.sent_in_doc = e.tgt_sent"""
_cql("q_project", '[pos="NOUN"] [pos="ADJ"] within component:fr =sentence=>', f"SELECT DISTINCT ts.start_pos, ts.end_pos FROM h {_TARGETS}", f"h AS (SELECT a.sent_idx, a.doc_idx FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_NOUN} AND b.{_ADJ} AND a.comp = 'fr' AND a.pos + 2 <= a.sent_end)")
_cql("q_project_filtered", '[pos="ADV"] =sentence=> within component:en within s', f"SELECT DISTINCT ts.start_pos, ts.end_pos FROM h {_TARGETS}", "h AS (SELECT sent_idx, doc_idx FROM t WHERE upos = 'ADV' AND comp = 'fr')")

# results
_add("q_context", lambda c: run(c, '[pos="ADJ"] [pos="NOUN"]').select("start_pos", "end_pos", "doc_idx", "sent_idx"), f"SELECT {_ONE}, a.pos + 2 AS end_pos, a.doc_idx, a.sent_idx FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_ADJ} AND b.{_NOUN}")
_add("q_page", lambda c: page(ranked(run(c, '[pos="NOUN"]')), 1000, 1000).select("hit_idx", "start_pos", "end_pos"), "SELECT row_number() OVER (ORDER BY pos) - 1 AS hit_idx, pos AS start_pos, pos + 1 AS end_pos FROM t WHERE upos = 'NOUN' QUALIFY hit_idx >= 1000 AND hit_idx < 2000")
_one = lambda c, n: c.spark.createDataFrame([(n,)], "n bigint")
_add("q_count", lambda c: _one(c, counts.count(c, '[pos="ADJ"] [pos="NOUN"] within s')), f"SELECT count(*) AS n FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_ADJ} AND b.{_NOUN} AND a.pos + 2 <= a.sent_end")
_add("q_count_all", lambda c: _one(c, counts.count(c, "[]")), "SELECT count(*) AS n FROM t")
_add("q_count_in_component", lambda c: _one(c, counts.count_in_component(c, 'a:[pos="NOUN"] [] b:[pos="NOUN"] :: a.lemma != b.lemma', "es")), f"SELECT count(*) AS n FROM t a JOIN t b ON b.pos = a.pos + 2 AND a.doc_idx = b.doc_idx WHERE a.{_NOUN} AND b.{_NOUN} AND a.comp = 'es' AND a.lemma <> b.lemma")
_add("q_count_by_document", lambda c: counts.count_by_document(c, '[pos="ADJ"] [pos="NOUN"]'), f"SELECT d.doc_idx, d.comp, d.doc_name, (SELECT count(*) FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.doc_idx = d.doc_idx AND a.{_ADJ} AND b.{_NOUN}) AS n FROM d")
_add("q_count_by_component", lambda c: counts.count_by_component(c, '[pos="PUNCT"] [pos="DET"]'), f"SELECT c.comp, (SELECT count(*) FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.comp = c.comp AND a.upos = 'PUNCT' AND b.{_DET} AND a.pos + 2 <= a.doc_end) AS n FROM components c")
_add("q_vocabulary", lambda c: counts.vocabulary(c, "lemma", "fr"), "SELECT DISTINCT lemma AS value FROM t WHERE lemma IS NOT NULL AND comp = 'fr'")
_add("q_value_counts", lambda c: counts.value_counts(c, "lemma"), "SELECT lemma AS value, count(*) AS n FROM t WHERE lemma IS NOT NULL GROUP BY 1")
_add("q_value_count", lambda c: _one(c, counts.value_count(c, "word", "garden")), "SELECT count(*) AS n FROM t WHERE word = 'garden'")
_two = [*CORE_LAYERS, *(f"feats.{k}" for k in FEATURES)]
_add("q_distinct_counts", lambda c: counts.distinct_counts(c).where(F.col("layer").isin(_two)), " UNION ALL ".join(f"SELECT '{x}' AS layer, CAST(0 AS BIGINT) AS n" if x in ("head", "deps") else f"SELECT '{x}' AS layer, count(DISTINCT {x}) AS n FROM t" for x in ("word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps")) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'feats.{k}', count(DISTINCT nullif(regexp_extract(feats, '(^|[|]){k}=([^|]*)', 2), '')) FROM t" for k in FEATURES))
# a key that only deliveries no longer valid have is none of the corpus
_add("q_distinct_counts_all", lambda c: counts.distinct_counts(c).where("n > 0 OR NOT startswith(layer, 'feats.')"), " UNION ALL ".join(f"SELECT '{x}' AS layer, CAST(0 AS BIGINT) AS n" if x in ("head", "deps") else f"SELECT '{x}' AS layer, count(DISTINCT {x}) AS n FROM t" for x in CORE_LAYERS) + " UNION ALL SELECT 'feats.' || split_part(kv, '=', 1), count(DISTINCT substr(kv, strpos(kv, '=') + 1)) FROM (SELECT unnest(string_split(feats, '|')) AS kv FROM t) WHERE contains(kv, '=') GROUP BY 1")
_add("q_component_tokens", counts.component_tokens, "SELECT c.comp, coalesce(max(d.end_pos) - min(d.start_pos), 0) AS n FROM components c LEFT JOIN d USING (comp) GROUP BY 1")
_add("q_spans_in_range", lambda c: _one(c, counts.spans_starting_in(c, "sentence", 500, 5000)), "SELECT count(*) AS n FROM s WHERE start_pos >= 500 AND start_pos < 5000")
_add("q_sentence_counts", counts.sentence_counts, "SELECT d.doc_idx, d.comp, d.doc_name, (SELECT count(*) FROM s WHERE s.doc_idx = d.doc_idx) AS n FROM d")
# alignments
_HITS = f"h AS (SELECT a.pos, a.sent_idx, a.doc_idx, a.comp, a.pos + 2 <= a.sent_end AS inside FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.{_NOUN} AND b.{_ADJ})"
_add("q_project_diagnostics", lambda c: navigation.project_hits(c, run(c, '[pos="NOUN"] [pos="ADJ"]'), "sentence")[1], f"""SELECT 'unmapped' AS counter, (SELECT count(*) FROM h WHERE comp <> 'fr' OR NOT inside) AS n UNION ALL
SELECT 'no_alignment', (SELECT count(*) FROM h JOIN s USING (sent_idx) JOIN d ON d.doc_idx = h.doc_idx WHERE h.comp = 'fr' AND inside AND NOT EXISTS (SELECT 1 FROM alignment_edges e WHERE e.align_name = 'sentence' AND e.src_doc = d.doc_in_comp AND e.src_sent = s.sent_in_doc)) UNION ALL
SELECT 'projected', (SELECT count(DISTINCT ts.sent_idx) FROM (SELECT * FROM h WHERE comp = 'fr' AND inside) h {_TARGETS})""", _HITS)
_add("q_alignment_coverage", lambda c: navigation.alignment_coverage(c, "sentence_es"), """SELECT d.doc_idx, d.doc_name, (SELECT count(*) FROM s WHERE s.doc_idx = d.doc_idx AND EXISTS (SELECT 1 FROM alignment_edges e WHERE e.align_name = 'sentence_es' AND e.src_doc = d.doc_in_comp AND e.src_sent = s.sent_in_doc)) AS aligned,
(SELECT count(*) FROM s WHERE s.doc_idx = d.doc_idx) AS total FROM d WHERE d.comp = 'es'""")
_add("q_alignments", navigation.alignments, "SELECT m.align_name, m.source_component, m.target_component, coalesce(m.source_layer, 'sentence') AS source_layer, coalesce(m.target_layer, 'sentence') AS target_layer, coalesce(m.directed, true) AS directed, (SELECT count(*) FROM alignment_edges e WHERE e.align_name = m.align_name) AS edge_count FROM alignment_meta m")
_add("q_alignment_edges", lambda c: navigation.alignment_edges(c, "sentence"), "SELECT * FROM alignment_edges WHERE align_name = 'sentence'")


def _project_range(c: Corpus) -> DataFrame:
    linked = c.alignment_edges.where("align_name = 'sentence'").select(F.col("src_doc").alias("doc_in_comp"))
    d = c.documents.where("comp = 'fr'").join(linked, "doc_in_comp", "left_semi").orderBy("doc_in_comp").first()
    if d is None:
        return c.sentences.limit(0).select("start_pos", "end_pos", "doc_idx", "sent_idx")
    return navigation.project_range(c, "sentence", d.doc_idx, d.start_pos + 3, d.start_pos + 60).select("start_pos", "end_pos", "doc_idx", "sent_idx")


_add("q_project_range", _project_range, """SELECT DISTINCT ts.start_pos, ts.end_pos, ts.doc_idx, ts.sent_idx FROM d JOIN s ON s.doc_idx = d.doc_idx AND s.start_pos < d.start_pos + 60 AND s.end_pos > d.start_pos + 3
JOIN alignment_edges e ON e.align_name = 'sentence' AND e.src_doc = d.doc_in_comp AND e.src_sent = s.sent_in_doc JOIN d td ON td.comp = 'en' AND td.doc_in_comp = e.tgt_doc JOIN s ts ON ts.doc_idx = td.doc_idx AND ts.sent_in_doc = e.tgt_sent
WHERE d.comp = 'fr' AND d.doc_in_comp = (SELECT min(src_doc) FROM alignment_edges WHERE align_name = 'sentence' AND src_doc IN (SELECT doc_in_comp FROM d WHERE comp = 'fr'))""")
# text
_ranges = lambda c: c.sentences.select(F.col("sent_idx").alias("k"), "start_pos", "end_pos")
_GLUE = "CASE WHEN coalesce(no_space_after, false) THEN '' ELSE ' ' END"
_add("q_surface", lambda c: text.surface_texts(c, _ranges(c), "k"), f"SELECT s.sent_idx AS k, s.start_pos, s.end_pos, (SELECT string_agg(word || CASE WHEN pos = s.end_pos - 1 THEN '' ELSE {_GLUE} END, '' ORDER BY pos) FROM t WHERE t.pos >= s.start_pos AND t.pos < s.end_pos) AS text FROM s")
_add("q_surface_units", lambda c: text.surface_units(c, _ranges(c), "k"), f"SELECT sent_idx AS k, pos AS start_pos, pos + 1 AS end_pos, CAST(ends - strlen(word) - strlen(g) AS BIGINT) AS byte_start, CAST(ends - strlen(g) AS BIGINT) AS byte_end, word AS form FROM (SELECT *, {_GLUE} AS g, sum(strlen(word) + strlen({_GLUE})) OVER (PARTITION BY sent_idx ORDER BY pos) AS ends FROM t)")
_AROUND = "string_agg(x.word || CASE WHEN x.pos = {last} THEN '' WHEN coalesce(x.no_space_after, false) THEN '' ELSE ' ' END, '' ORDER BY x.pos)"
_KWIC = "(SELECT coalesce({agg}, '') FROM t x WHERE x.pos >= {a} AND x.pos < {b})"
_N = "(SELECT max(end_pos) FROM d)"
_add("q_kwic", lambda c: text.kwic(c, run(c, '[lemma="garden"] [pos="ADP"]')), f"SELECT d.doc_name, h.pos AS start_pos, h.pos + 2 AS end_pos, {_KWIC.format(agg=_AROUND.format(last='h.pos - 1'), a='h.pos - 5', b='h.pos')} AS \"left\", {_KWIC.format(agg=_AROUND.format(last='h.pos + 1'), a='h.pos', b='h.pos + 2')} AS match, {_KWIC.format(agg=_AROUND.format(last=f'least(h.pos + 7, {_N}) - 1'), a='h.pos + 2', b='h.pos + 7')} AS \"right\" FROM h JOIN d USING (doc_idx)", "h AS (SELECT a.pos, a.doc_idx FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.lemma = 'garden' AND b.upos = 'ADP')")
_add("q_context_tokens", lambda c: text.context_tokens(c, run(c, '[lemma="garden"]'), "lemma", 3), "SELECT h.pos AS start_pos, h.pos + 1 AS end_pos, x.pos, x.pos - h.pos AS relative, coalesce(x.lemma, '') AS value FROM t h JOIN t x ON x.pos BETWEEN h.pos - 3 AND h.pos + 3 WHERE h.lemma = 'garden'")
_add("q_collocations", lambda c: text.collocations(c, run(c, '[pos="ADJ"]'), "upos", 2), f"SELECT x.pos - h.pos AS relative, coalesce(x.upos, '') AS value, count(*) AS n FROM t h JOIN t x ON x.pos BETWEEN h.pos - 2 AND h.pos + 2 WHERE h.{_ADJ} GROUP BY 1, 2")
_add("q_layer_texts", lambda c: text.layer_texts(c, _ranges(c), "k", "lemma"), "SELECT s.sent_idx AS k, s.start_pos, s.end_pos, coalesce((SELECT string_agg(lemma, ' ' ORDER BY pos) FROM t WHERE t.pos >= s.start_pos AND t.pos < s.end_pos), '') AS text FROM s")
_add("q_annotations", lambda c: text.annotations_long(c, 100, 400, ["word", "upos", "head"]), "SELECT pos, layer, value, CASE WHEN layer = 'head' THEN 'int' ELSE 'string' END AS kind FROM (SELECT pos, unnest(['word', 'upos', 'head']) AS layer, unnest([word, upos, CAST(head AS VARCHAR)]) AS value FROM t WHERE pos >= 100 AND pos < 400) WHERE value IS NOT NULL")
_add("q_annotation_values", lambda c: text.annotations(c, run(c, '[pos="ADV"]').select(F.col("start_pos").alias("pos")), "head"), "SELECT pos, coalesce(CAST(head AS VARCHAR), '') AS value FROM t WHERE upos = 'ADV'")
# navigation
_add("q_documents", lambda c: navigation.documents(c, "fr"), "SELECT doc_idx, comp, doc_name FROM d WHERE comp = 'fr'")
_add("q_components", navigation.components, "SELECT c.comp_id, c.comp, c.lang, min(d.doc_idx) AS doc_start, max(d.doc_idx) + 1 AS doc_end FROM components c LEFT JOIN d USING (comp) GROUP BY ALL")
_add("q_span_containing", lambda c: navigation.span_containing(c, "sentence", 1234), "SELECT sent_idx AS idx, start_pos, end_pos FROM s WHERE start_pos <= 1234 AND end_pos > 1234")
_add("q_sentence_span", lambda c: navigation.sentence_span(c, "es", 1, 2), "SELECT s.sent_idx, s.start_pos, s.end_pos FROM s JOIN d USING (doc_idx) WHERE d.comp = 'es' AND d.doc_in_comp = 1 AND s.sent_in_doc = 2")
_add("q_document_for_position", lambda c: navigation.document_for_position(c, 1234).select("doc_idx", "comp", "doc_name"), "SELECT doc_idx, comp, doc_name FROM d WHERE start_pos <= 1234 AND end_pos > 1234")
_add("q_document_by_stem", lambda c: navigation.resolve_document(c, "bitter_basket_000008.en", strict=False).select("doc_idx", "doc_name"), "SELECT doc_idx, doc_name FROM d WHERE doc_name = 'bitter_basket_000008.en.conllu'")
_add("q_info", lambda c: (lambda i: c.spark.createDataFrame([(i["token_count"], i["document_count"], ",".join(i["components"]), ",".join(i["alignments"]))], "token_count bigint, document_count bigint, components string, alignments string"))(navigation.info(c)), "SELECT (SELECT max(end_pos) FROM d) AS token_count, (SELECT count(*) FROM d) AS document_count, (SELECT string_agg(comp, ',' ORDER BY comp_id) FROM components) AS components, (SELECT string_agg(align_name, ',' ORDER BY align_name) FROM alignment_meta) AS alignments")


def _as_conllu(c: Corpus, units: bool = False) -> DataFrame:
    """Every document as the text of one file. `units`: ADP and DET after it make a multi-word token, and an empty node
    follows each CCONJ."""
    cell = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("_"))
    t = c.tokens("doc_idx", "sent_in_doc", "tok_in_sent", "word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "no_space_after")
    row = F.concat_ws("\t", cell("tok_in_sent"), *[cell(x) for x in ("word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps")], F.when(F.col("no_space_after"), "SpaceAfter=No").otherwise("_"))
    if units:
        w = Window.partitionBy("doc_idx", "sent_in_doc").orderBy("tok_in_sent")
        blank = F.lit("\t_" * 8)
        t = t.withColumns({"next_upos": F.lead("upos").over(w), "next_word": F.lead("word").over(w)})
        fused = F.when(F.expr("upos = 'ADP' AND next_upos = 'DET'"), F.concat(F.expr("concat(tok_in_sent, '-', tok_in_sent + 1)"), F.lit("\t"), "word", F.lit("+"), "next_word", blank))
        node = F.when(F.col("upos") == "CCONJ", F.concat(F.expr("concat(tok_in_sent, '.1')"), F.lit("\tE:"), "word", blank))
        row = F.concat_ws("\n", fused, row, node)
    sents = t.groupBy("doc_idx", "sent_in_doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_in_sent", row.alias("r")))), lambda x: x["r"]), "\n").alias("r"))
    docs = sents.groupBy("doc_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_in_doc", "r"))), lambda x: x["r"]), "\n\n").alias("value"))
    return docs.join(c.documents.select("doc_idx", "doc_name"), "doc_idx").select(F.concat_ws("/", F.lpad(F.col("doc_idx").cast("string"), 12, "0"), "doc_name").alias("file"), "value")


def _conllu(c: Corpus) -> DataFrame:
    b = assemble(c.spark, "again", [(None, ConlluReader().parse(_as_conllu(c)))])
    return b.tokens("doc_idx", "sent_idx", "tok_in_sent", "sent_end", "doc_end", "word", "lemma", "upos", "feats", "head", "no_space_after")


_absent = lambda x: f"nullif(nullif({x}, '_'), '') AS {x}"
_add("q_conllu_round_trip", _conllu, f"SELECT pos, doc_idx, sent_idx, tok_in_sent, sent_end, doc_end, word, {_absent('lemma')}, {_absent('upos')}, {_absent('feats')}, head, coalesce(no_space_after, false) AS no_space_after FROM t")
QUERIES["q_plain_text"] = lambda spark, sf_dir: PlainTextReader().parse(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("value"))).rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
SQL["q_plain_text"] = r"SELECT unnest(regexp_extract_all(line, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) AS word, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"


def _units(c: Corpus) -> Corpus:
    return assemble(c.spark, "units", [(None, ConlluReader().parse(_as_conllu(c, units=True)))])


def _from_files(c: Corpus) -> DataFrame:
    """Documents written as files, built from their folder with the strict reader, stored and opened."""
    path = new_path(c.spark, "files")
    _as_conllu(c).select(F.element_at(F.split("file", "/"), 1).alias("doc"), "value").write.partitionBy("doc").text(path, lineSep="\n")
    built = build_directory(c.spark, path, "files", strict=True, reader=ConlluReader("*.txt"))
    store.save(built, f"{path}-stored")
    return store.open_corpus(c.spark, f"{path}-stored").tokens("sent_idx", "sent_in_doc", "doc_idx", "word", "lemma", "head", "no_space_after")


def _named_results(c: Corpus) -> DataFrame:
    """A result saved under a name in one session, loaded and paged in the next."""
    state = new_path(c.spark, "state")
    first = Results(c, state)
    first.save(first.execute('[pos="ADJ"]').handle, "adjectives")
    later = Results(c, state)
    return later.hits(later.load("adjectives")["handle"], 500, 250)[0].select("hit_idx", "start_pos", "end_pos")


_PAIRED = "u AS (SELECT *, lead(upos) OVER w AS next_upos, lead(word) OVER w AS next_word, lag(upos) OVER w AS last_upos FROM t WINDOW w AS (PARTITION BY sent_idx ORDER BY pos))"
_add("q_files_round_trip", _from_files, f"SELECT pos, sent_idx, sent_in_doc, doc_idx, word, {_absent('lemma')}, head, coalesce(no_space_after, false) AS no_space_after FROM t")
_add("q_mwt", lambda c: _units(c).mwt, "SELECT pos AS start_pos, pos + 2 AS end_pos, word || '+' || next_word AS form, false AS no_space_after FROM u WHERE upos = 'ADP' AND next_upos = 'DET'", _PAIRED)
_add("q_mwt_in_range", lambda c: text.mwts_in(_units(c), 301, 2000).select("start_pos", "end_pos"), "SELECT pos AS start_pos, pos + 2 AS end_pos FROM u WHERE upos = 'ADP' AND next_upos = 'DET' AND pos < 2000 AND pos + 2 > 301", _PAIRED)
_add("q_mwt_surface", lambda c: (lambda b: text.surface_texts(b, _ranges(b), "k"))(_units(c)), """SELECT s.sent_idx AS k, s.start_pos, s.end_pos, (SELECT string_agg(CASE WHEN upos = 'ADP' AND next_upos = 'DET' THEN word || '+' || next_word || CASE WHEN pos = s.end_pos - 2 THEN '' ELSE ' ' END
ELSE word || CASE WHEN pos = s.end_pos - 1 OR coalesce(no_space_after, false) THEN '' ELSE ' ' END END, '' ORDER BY pos) FROM u WHERE u.pos >= s.start_pos AND u.pos < s.end_pos AND NOT coalesce(upos = 'DET' AND last_upos = 'ADP', false)) AS text FROM s""", _PAIRED)
_add("q_empty_nodes", lambda c: _units(c).empty_nodes.select("sent_idx", "node_id", "form"), "SELECT sent_idx, tok_in_sent || '.1' AS node_id, 'E:' || word AS form FROM t WHERE upos = 'CCONJ'")
_add("q_named_results", _named_results, f"SELECT row_number() OVER (ORDER BY pos) - 1 AS hit_idx, pos AS start_pos, pos + 1 AS end_pos FROM t WHERE {_ADJ} QUALIFY hit_idx >= 500 AND hit_idx < 750")
_add("q_sentence_ids", lambda c: c.sentences.select("sent_idx", "sent_id"), "SELECT sent_idx, sent_id FROM s")
_add("q_sentences_of_document", lambda c: navigation.sentences(c, 3, 2, 9).select("sent_idx", "start_pos", "end_pos"), "SELECT sent_idx, start_pos, end_pos FROM s WHERE doc_idx = 3 AND sent_in_doc >= 2 AND sent_in_doc < 9")
_add("q_document_for_sentence", lambda c: navigation.document_for_sentence(c, 77).select("doc_idx", "doc_name"), "SELECT doc_idx, doc_name FROM d WHERE doc_idx = (SELECT doc_idx FROM s WHERE sent_idx = 77)")
_add("q_edge_sentences", lambda c: c.spark.createDataFrame([navigation.edge_sentences(c, 4)], "first int, last int"), "SELECT min(sent_idx) AS first, max(sent_idx) AS last FROM s WHERE doc_idx = 4")
_add("q_component_of_document", lambda c: c.spark.createDataFrame([(navigation.component_for_document(c, 5), ",".join(navigation.components_of_language(c, "fr")))], "comp string, french string"), "SELECT (SELECT comp FROM d WHERE doc_idx = 5) AS comp, coalesce((SELECT string_agg(comp, ',' ORDER BY comp_id) FROM components WHERE lang = 'fr'), '') AS french")
_add("q_layer_kinds", lambda c: c.spark.createDataFrame([(x, c.layer_kind(x), x in c.indexed_layers) for x in c.layers if not x.startswith("feats.")], "layer string, kind string, indexed boolean"), "SELECT unnest(['word', 'lemma', 'upos', 'xpos', 'feats', 'head', 'deprel', 'deps']) AS layer, CASE WHEN layer = 'head' THEN 'int' ELSE 'string' END AS kind, layer NOT IN ('head', 'deps') AS indexed")
_add("q_count_in_document", lambda c: counts.count_by_document(c, '[pos="NOUN"]', document="bitter_basket_000008.en", strict=False).select("doc_name", "n"), f"SELECT doc_name, (SELECT count(*) FROM t WHERE t.doc_idx = d.doc_idx AND {_NOUN}) AS n FROM d WHERE doc_name = 'bitter_basket_000008.en.conllu'")
_add("q_count_by_document_of_component", lambda c: counts.count_by_document(c, '[pos="NOUN"] [pos="ADJ"]', component="es").select("doc_idx", "n"), f"SELECT doc_idx, (SELECT count(*) FROM t a JOIN t b ON b.pos = a.pos + 1 WHERE a.doc_idx = d.doc_idx AND a.{_NOUN} AND b.{_ADJ}) AS n FROM d WHERE comp = 'es'")
_add("q_vocabulary_of_document", lambda c: counts.vocabulary(c, "word", document="bitter_basket_000008.en.conllu", strict=False), "SELECT DISTINCT word AS value FROM t WHERE doc_idx IN (SELECT doc_idx FROM d WHERE doc_name = 'bitter_basket_000008.en.conllu') AND word IS NOT NULL")
_add("q_step_voided", lambda c: run(c, '([pos=/[/] | [pos="NOUN"]) [pos="VERB"]').select("start_pos", "end_pos"), "SELECT pos AS start_pos, pos AS end_pos FROM t WHERE false")
_cql("q_regex_ascii", "[word=/^[[:alpha:]]+$/]", f"{_S} WHERE regexp_full_match(word, '[a-zA-Z]+')")
_cql("q_regex_repeated", "[word=/^(?:[a-z]{2}+)e$/]", f"{_S} WHERE regexp_full_match(word, '(?:[a-z]{{2}})+e')")
_cql("q_regex_end", r"[word=/^.[^\s]é$/]", rf"{_S} WHERE regexp_full_match(word, '.[^\s]é')")
