"""Readers, builder, store, counts, text, navigation, results and sessions on small corpora."""

import dataclasses
import shutil

import pytest
from pyspark.sql import functions as F

from corpusq import errors
from corpusq.functions import storage
from corpusq.operators import counts, navigation, text
from corpusq.plans.compiler import run
from corpusq.session import Session
from corpusq.sources import store
from corpusq.sources.build import CorpusBuilder, build_directory, build_manifest, read_manifest
from corpusq.sources.readers import ConlluReader, PlainTextReader
from tests.fixtures import FUSED, HERONS, TIGHT, conllu
from tests.test_cql import cached, spans

FR = {"moulin": ["la/le/DET roue/roue/NOUN tourne/tourner/VERB vite/vite/ADV ././PUNCT", "un/un/DET âne/âne/NOUN dort/dormir/VERB ././PUNCT"], "phare": ["le/le/DET vent/vent/NOUN dort/dormir/VERB ././PUNCT", "il/il/PRON revient/revenir/VERB ././PUNCT"]}
EN = {"harbour": ["the/the/DET wind/wind/NOUN sleeps/sleep/VERB ././PUNCT", "it/it/PRON returns/return/VERB ././PUNCT"], "orchard": ["the/the/DET wheel/wheel/NOUN turns/turn/VERB fast/fast/ADV ././PUNCT", "a/a/DET donkey/donkey/NOUN sleeps/sleep/VERB ././PUNCT"]}
TOML = """[corpus]
name = "par"
[components.fr]
path = "fr"
language = "fr"
[components.en]
path = "en"
[alignments.sent]
source = "fr"
target = "en"
edges = "edges"
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("par")
    for name, docs in (("fr", FR), ("en", EN)):
        (d / name).mkdir()
        for doc, s in docs.items():
            (d / name / f"{doc}.conllu").write_text(conllu(s), encoding="utf-8")
    (d / "corpus.toml").write_text(TOML)
    (d / "edges").mkdir()
    rows = ["# pairs", "", "phare.conllu\t0\torchard.conllu\t1\tmore", "phare.conllu\t1\torchard.conllu\t0", "moulin.conllu\t1\tharbour.conllu\t0", "moulin.conllu\t1\tharbour.conllu\t0"]
    (d / "edges" / "a.tsv").write_text("\n".join(rows))
    (d / "edges" / "b.tsv").write_text("moulin.conllu\t1\torchard.conllu\t9\nnone\t0\tharbour.conllu\t0\nshort\t1\n")
    return d


@pytest.fixture(scope="module")
def par(spark, folder):
    return cached(build_manifest(spark, str(folder / "corpus.toml")))


def test_manifest_and_order(spark, folder, par):
    docs = [(r.doc_idx, r.doc_in_comp, r.comp, r.doc_name, r.start_pos, r.end_pos) for r in par.documents.orderBy("doc_idx").collect()]
    assert docs == [(0, 0, "en", "harbour.conllu", 0, 7), (1, 1, "en", "orchard.conllu", 7, 16), (2, 0, "fr", "moulin.conllu", 16, 25), (3, 1, "fr", "phare.conllu", 25, 32)]
    assert [r.pos for r in par.tokens().orderBy("pos").collect()] == list(range(32))
    assert navigation.info(par)["token_count"] == 32 and navigation.info(par)["components"] == ["en", "fr"]
    with pytest.raises(errors.FormatError):
        build_manifest(spark, str(folder / "corpus.toml"), strict=True)
    (folder / "bad.toml").write_text("[corpus]\n")
    with pytest.raises(errors.FormatError):
        read_manifest(spark, str(folder / "bad.toml"))
    (folder / "edges" / "c.tsv").write_text("phare.conllu\tx\tharbour.conllu\t0\n")
    with pytest.raises(errors.FormatError):
        build_manifest(spark, str(folder / "corpus.toml"))
    (folder / "edges" / "c.tsv").unlink()


def test_counts(par):
    noun = '[pos="NOUN"]'
    assert counts.count(par, noun) == 6 and counts.count_in_component(par, noun, "fr") == 3 and counts.count_in_component(par, noun, "xx") == 0
    assert counts.count_in_component(par, "a:[] :: a.lemma = a.lemma", "fr") == 16 and counts.count(par, 'a:[pos="DET"] b:[pos="NOUN"]+ within s') == 6
    assert [(r.comp, r.doc_name, r.n) for r in counts.count_by_document(par, '[lemma="dormir"]').orderBy("doc_idx").collect()] == [("en", "harbour.conllu", 0), ("en", "orchard.conllu", 0), ("fr", "moulin.conllu", 1), ("fr", "phare.conllu", 1)]
    assert [r.n for r in counts.count_by_document(par, noun, document="phare").collect()] == [1]
    assert [r.n for r in counts.count_by_document(par, noun, component="en").collect()] == [1, 2]
    assert {r.comp: r.n for r in counts.count_by_component(par, '[pos="DET"] []').collect()} == {"en": 3, "fr": 3}
    assert [r.value for r in counts.vocabulary(par, "pos", "fr").collect()] == ["ADV", "DET", "NOUN", "PRON", "PUNCT", "VERB"]
    assert [r.value for r in counts.vocabulary(par, "word", "fr", "phare.conllu").collect()] == [".", "dort", "il", "le", "revient", "vent"]
    for bad in (("nope", None), ("head", None), ("word", "xx")):
        with pytest.raises(errors.CorpusError):
            counts.vocabulary(par, *bad)
    assert {r.value: r.n for r in counts.value_counts(par, "upos").collect()}["PUNCT"] == 8
    assert counts.value_count(par, "lemma", "dormir") == 2 and counts.value_count(par, "lemma", "x") == counts.value_count(par, "head", "x") == -1
    assert counts.distinct_count(par, "upos") == 6 and counts.distinct_count(par, "head") == 0
    assert {r.layer: r.n for r in counts.distinct_counts(par).collect()} == {x: counts.distinct_count(par, x) for x in par.layers}
    assert {r.comp: r.n for r in counts.component_tokens(par).collect()} == {"en": 16, "fr": 16}
    assert counts.spans_starting_in(par, "sentence", 0, 8) == 3 and counts.spans_starting_in(par, "x", 0, 8) == -1
    assert [r.n for r in counts.sentence_counts(par).orderBy("doc_idx").collect()] == [2, 2, 2, 2]


def test_projection(par):
    assert spans(par, '[lemma="vent"] within component:"fr" =sent=>') == [(12, 16)]
    assert spans(par, '[pos="VERB"] within component:fr =sent=>') == [(0, 4), (7, 12), (12, 16)]
    assert spans(par, '[pos="PRON"] =sent=> within doc:"orchard.conllu"') == [(7, 12)] and spans(par, '[pos="PRON"] =sent=> within doc:x') == []
    assert spans(par, '[pos="NOUN"] [] =sent=> within component:en within s') == [(0, 4), (12, 16)]
    targets, counters = navigation.project_hits(par, run(par, '[pos="VERB"]'), "sent")
    assert targets.count() == 3 and {r.counter: r.n for r in counters.collect()} == {"unmapped": 4, "no_alignment": 1, "projected": 3}
    assert [(r.doc_name, r.aligned, r.total) for r in navigation.alignment_coverage(par, "sent").orderBy("doc_idx").collect()] == [("moulin.conllu", 1, 2), ("phare.conllu", 2, 2)]
    assert [(r.start_pos, r.end_pos, r.nr) for r in navigation.project_range(par, "sent", 3, 27, 30).collect()] == [(12, 16, 0), (7, 12, 1)]
    assert [r.edge_no for r in par.alignment_edges.orderBy("edge_no").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(errors.OutsideSource):
        navigation.project_range(par, "sent", 0, 0, 1)
    with pytest.raises(errors.UnknownAlignment):
        navigation.project_range(par, "x", 0, 0, 1)
    assert navigation.alignments(par).first().edge_count == 5 and navigation.alignment_edges(par, "sent").count() == 5


def test_navigation(par):
    one = lambda df, *c: [tuple(r[x] for x in c) for r in df.collect()]
    assert one(navigation.span_containing(par, "sentence", 8), "idx", "start_pos", "end_pos") == [(2, 7, 12)]
    assert one(navigation.span_at(par, "document", 3), "start_pos", "end_pos") == [(25, 32)] and navigation.span_count(par, "sentence") == 8
    assert one(navigation.document_for_position(par, 31), "doc_idx") == [(3,)] and one(navigation.document_for_sentence(par, 4), "doc_idx") == [(2,)]
    assert navigation.edge_sentences(par, 1) == (2, 3) and navigation.edge_sentences(par, 9) is None
    assert one(navigation.sentence_span(par, "fr", 1, 1), "start_pos", "end_pos") == [(29, 32)]
    assert navigation.sentences(par, 0, 0, 99).count() == 2 and navigation.sentence_id(par, 7) == "2" and navigation.sentence_id(par, 99) is None
    assert navigation.component_for_document(par, 2) == "fr" and navigation.components_of_language(par, "fr") == ["fr"]
    assert navigation.document_indices(par, "phare.conllu") == [3] and navigation.document_at(par, 9).count() == 0
    assert one(navigation.components(par).orderBy("comp_id"), "comp", "doc_start", "doc_end") == [("en", 0, 2), ("fr", 2, 4)]
    assert one(navigation.documents(par, "en"), "doc_name") == [("harbour.conllu",), ("orchard.conllu",)]
    with pytest.raises(errors.NotFound):
        navigation.documents(par, "xx")
    with pytest.raises(errors.NotFound):
        navigation.resolve_document(par, "xx")


def test_units_and_text(spark):
    c = cached(CorpusBuilder(spark, "m", decompose=True).add_document("m", FUSED).add_document("g", TIGHT).build())
    assert text.surface_text(c, 0, 7) == "Sale del molino y canta…" and text.surface_text(c, 7, 10) == "¡Nieva!" and text.surface_text(c, 10, 13) == "kova-lume"
    assert text.surface_text(c, 2, 4) == "molino" and text.surface_text(c, 1, 2) == "del" and text.surface_text(c, 4, 4) == ""
    r = spark.createDataFrame([(1, 0, 7), (2, 1, 2), (3, 7, 10)], "k int, start_pos bigint, end_pos bigint")
    units = {k: [(u.start_pos, u.end_pos, u.byte_start, u.byte_end, u.form) for u in text.surface_units(c, r, "k").orderBy("start_pos").collect() if u.k == k] for k in (1, 2, 3)}
    assert units[1] == [(0, 1, 0, 4, "Sale"), (1, 3, 5, 8, "del"), (3, 4, 9, 15, "molino"), (4, 5, 16, 17, "y"), (5, 6, 18, 23, "canta"), (6, 7, 23, 26, "…")]
    assert units[2] == [(1, 2, 0, 2, "de")] and units[3][-1] == (9, 10, 7, 8, "!")
    assert {x.k: x.text for x in text.layer_texts(c, r, "k", "lemma").collect()} == {1: "salir de el molino y cantar …", 2: "de", 3: "¡ nevar !"}
    assert [(x.left, x.match, x.right) for x in text.kwic(c, run(c, '[lemma="de"]')).collect()] == [("Sale", "del", "molino y canta…")]
    assert [(x.left, x.match, x.right) for x in text.kwic(c, run(c, '[lemma="lume"]'), 2).collect()] == [("kova-", "lume", "")]
    ctx = text.context_tokens(c, run(c, '[lemma="salir"]'), "feats", 3).orderBy("pos").collect()
    assert [(x.relative, x.value) for x in ctx] == [(0, ""), (1, ""), (2, ""), (3, "Gender=Masc|Number=Sing")]
    assert {(x.relative, x.value): x.n for x in text.collocations(c, run(c, '[pos="DET"]'), "upos", 1).collect()} == {(-1, "ADP"): 1, (-1, "PART"): 1, (0, "DET"): 2, (1, "NOUN"): 2}
    assert c.layers[-2:] == ("feats.Gender", "feats.Number") and spans(c, '[feats.Number="Sing"]') == [(3, 4)] and len(spans(c, '[feats.Number!="Sing"]')) == 12
    assert text.annotation(c, 0, "head") == "0" and text.annotation(c, 8, "head") is None and text.annotation(c, 0, "nope") is None
    long = text.annotations_long(c, 2, 3).collect()
    assert {(x.layer, x.value, x.kind) for x in long} == {("word", "el", "string"), ("lemma", "el", "string"), ("upos", "DET", "string"), ("head", "4", "int"), ("deprel", "det", "string"), ("deps", "4:det", "string")}
    with pytest.raises(errors.BadRange):
        text.annotations_long(c, 2, 1)
    assert text.mwt_covering(c, 2).first().form == "del" and text.mwts_in(c, 0, 2).count() == 1 and text.mwts_in(c, 0, 1).count() == 0
    assert text.no_space_after(c, 5) and not text.no_space_after(c, 4) and text.empty_nodes_of(c, 0).first().node_id == "5.1"
    assert [x.sent_id for x in c.sentences.orderBy("sent_idx").collect()] == ["fused-1", "g:0", "g:1"]
    assert [x.value for x in text.annotations(c, spark.createDataFrame([(0,), (3,)], "pos bigint"), "feats").orderBy("pos").collect()] == ["", "Gender=Masc|Number=Sing"]


def test_readers(spark, tmp_path):
    good = conllu(HERONS[:1]) + "\n1\tx\ty\n2\tx\ty\n\n" + conllu(HERONS[1:3])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.conllu").write_text(good)
    (tmp_path / "a.conllu").write_text("# only a comment\n\n")
    (tmp_path / "c.txt").write_text("Hello, world!\n\nIt's 5.")
    c = cached(build_directory(spark, str(tmp_path), "dir"))
    assert counts.token_count(c) == 16 and c.documents.first().doc_name == "b.conllu" and c.components.count() == 0
    assert ConlluReader().read(spark, str(tmp_path)).skipped.count() == 1
    with pytest.raises(errors.FormatError, match=r"b.conllu:9"):
        build_directory(spark, str(tmp_path), strict=True)
    t = cached(build_directory(spark, "file://" + str(tmp_path), reader=PlainTextReader()))
    assert text.surface_text(t, 0, 4) == "Hello, world!" and text.surface_text(t, 4, 9) == "It's 5." and t.sentences.count() == 2
    assert spans(c, "[] within component:dir") == []


def test_comments_and_blanks_around_rows(spark):
    row = lambda end: "1\tx\tx\tNOUN\t_\t_\t0\troot\t_\t" + end
    files = [("a", "# sent_id = one\n  # sent_id = two  \n#sent_id = three\n# sent_id : four\n" + row("_")), ("b", "\t " + row("_  ")), ("c", row("")), ("d", "# sent_id=five\n" + row("_\r") + "\n \t\n" + row("_"))]
    parsed = ConlluReader().parse(spark.createDataFrame(files, "file string, value string"))
    assert sorted((r.file, r.sent_no, r.sent_id, r.misc) for r in parsed.rows.collect()) == [("a", 0, "two", "_"), ("b", 0, None, "_"), ("d", 0, "five", "_"), ("d", 1, None, "_")]
    assert [r.file for r in parsed.skipped.collect()] == ["c"]  # the empty last column is cut off with the blanks


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_store(spark, par, tmp_path, scheme):
    path = scheme + str(tmp_path / "out")
    store.save(par, path)
    with pytest.raises(errors.CorpusError):
        store.save(par, path)
    store.save(par, path, force=True)
    assert [x.name for x in tmp_path.iterdir()] == ["out"]
    back = store.open_corpus(spark, path)
    for q in ('[pos="DET"] []', '[pos="VERB"] within component:fr =sent=>'):
        assert spans(back, q) == spans(par, q)
    assert navigation.info(back)["token_count"] == 32
    shutil.rmtree(tmp_path / "out" / "mwt")
    with pytest.raises(errors.CorpusError, match="mwt"):
        store.open_corpus(spark, path)
    meta = (tmp_path / "out" / "corpus.json").read_text()
    (tmp_path / "out" / "corpus.json").write_text(meta.replace(', "mwt"', "").replace('"mwt",', ""))
    for crc in (tmp_path / "out").glob(".*.crc"):
        crc.unlink()
    assert store.open_corpus(spark, path).mwt.count() == 0
    (tmp_path / "out" / "corpus.json").write_text(meta.replace('"version": 1', '"version": 0'))
    with pytest.raises(errors.VersionMismatch):
        store.open_corpus(spark, path)
    with pytest.raises(errors.CorpusError):
        store.open_corpus(spark, path + "-none")


def test_a_failed_save_leaves_the_old_corpus(spark, par, tmp_path):
    path = str(tmp_path / "out")
    store.save(par, path)
    broken = dataclasses.replace(par, mwt=par.mwt.withColumn("form", F.expr("raise_error('x')").cast("string")).union(spark.createDataFrame([(0, 1, "x", False)], par.mwt.schema)).withColumn("form", F.expr("assert_true(form <> 'x')").cast("string")))
    with pytest.raises(Exception):
        store.save(broken, path, force=True)
    assert store.open_corpus(spark, path).documents.count() == 4


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "spark://m:7077", "a"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Cluster:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Cluster)
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Cluster)


def test_results_and_session(par, tmp_path):
    s = Session(par, str(tmp_path))
    r = s.results.execute('[pos="NOUN"]')
    rows, total = s.results.hits(r.handle, 2, 2)
    assert total == 6 and [x.start_pos for x in rows.collect()] == [x for x, _ in spans(par, '[pos="NOUN"]')][2:4]
    assert s.results.hits(r.handle, 10, 5)[0].count() == 0 and s.results.execute_count('[pos="NOUN"]') == 6
    heard = []
    a = s.register("view", lambda *x: heard.append(("a", *x)), provides=("sentence", "hit", "position"), label="A")
    b = s.register("view", lambda *x: heard.append(("b", *x)), consumes=("span", "sentence"))
    s.subscribe(b, "named_results_changed")
    s.results.save(r.handle, "nouns")
    for call, code in ((lambda: s.results.hits(r.handle, 0, 1001), 1203), (lambda: s.results.hits("x"), 1200), (lambda: s.results.save(r.handle, "nouns"), 1201), (lambda: s.results.load("x"), 1202), (lambda: s.subscribe(a, "x"), 1600), (lambda: s.couple(a, b, "x"), 1403), (lambda: s.couple(b, a, "alignment"), 1400), (lambda: s.couple(a, a, "alignment"), 1402), (lambda: s.uncouple(9), 1401), (lambda: s.update_label(9, "x"), 1500)):
        with pytest.raises(errors.CorpusError) as e:
            call()
        assert e.value.code == code
    assert s.results.materialize("nouns")["form"] == "materialized"
    with pytest.raises(errors.AlreadyMaterialized):
        s.results.materialize("nouns")
    s.results.discard(r.handle)
    assert s.results.metadata(r.handle)["count"] == 6 and heard == [("b", "named_results_changed", {"event": "saved", "name": "nouns"})]
    heard.clear()
    s.publish_interest(a, {"kind": "sentence", "doc": 3, "sent": 0})
    k = s.couple(a, b, "alignment", "sent")
    assert heard == [("b", "coupler_update", {"coupler": k, "interest": {"kind": "span", "doc": 1, "start": 12, "end": 16}})]
    heard.clear()
    m, h = s.couple(a, b, "sentence_mirror"), s.couple(a, b, "kwic_selection")
    s.publish_interest(a, {"kind": "position", "doc": 1, "position": 8})
    s.publish_interest(a, {"kind": "position", "doc": 0, "position": 8})
    s.publish_interest(a, {"kind": "hit", "result": r.handle, "hit": 0})
    s.publish_interest(a, {"kind": "results"})
    assert [(x[2]["coupler"], x[2]["interest"]) for x in heard] == [(m, {"kind": "sentence", "doc": 3, "sent": 0}), (m, {"kind": "sentence", "doc": 1, "sent": 0}), (h, {"kind": "span", "doc": 0, "start": 1, "end": 2})]
    assert len(s.coupled(a)) == 3 and [c.id for c in s.roster(consumes_any=("span",))] == [b]
    s.unregister(b)
    assert s.coupled() == []
    later = Session(par, str(tmp_path))
    assert later.results.load("nouns")["handle"] == r.handle and later.results.list_named()[0]["count"] == 6
    later.results.delete_named("nouns")
    assert Session(par, str(tmp_path)).results.named == {}
