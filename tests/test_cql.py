"""The query language: hand-made expectations on one small text, loops over lists for everything that can be composed."""

import random

import pytest

from corpusq.errors import ExecutionError, ParseError, UnknownAlignment, UnknownLabel
from corpusq.plans import cql
from corpusq.plans.compiler import Options, captures, run
from corpusq.sources.build import CorpusBuilder
from tests import brute
from tests.fixtures import HERONS, conllu, tags


def cached(corpus):
    """Token columns kept in memory: these corpora are tiny and asked often."""
    t = corpus.tokens(*corpus.layers, "doc_idx", "doc_in_comp", "sent_idx", "sent_in_doc", "tok_in_sent", "comp", "sent_end", "doc_end", "no_space_after").coalesce(1).cache()
    corpus.tokens_of = lambda columns: t.select("pos", *[f"`{c}`" for c in columns])
    return corpus


@pytest.fixture(scope="module")
def herons(spark):
    return cached(CorpusBuilder(spark, "herons").add_document("pond", conllu(HERONS)).build())


def spans(corpus, q, **kw):
    return sorted((r.start_pos, r.end_pos) for r in run(corpus, q, **kw).collect())


@pytest.fixture(scope="module")
def ask(herons):
    return lambda q, **kw: spans(herons, q, **kw)


def single(*positions):
    return [(p, p + 1) for p in positions]


def test_token_tests(ask):
    assert ask('[lemma="heron"]') == single(3, 7)
    assert ask('"boats"') == ask('[word="boats"]') == single(17, 22)
    assert ask("[word=/s$/]") == single(3, 9, 17, 22) and ask("[word=/(?i)^a$/]") == single(6)
    assert ask('[pos="ADV" & word!=/^.{5}$/]') == single(20, 25)
    assert len(ask("[]")) == 26 and len(ask('[pos!="ADJ"]')) == 20
    assert ask('[xpos="num" & upos="NUM"]') == single(0)
    # layers that can't be tested, or that don't exist, hold no value
    assert ask('[head="0"]') == ask('[colour="grey"]') == [] and len(ask('[deps!="x"]')) == 26


def test_neighbours(ask):
    assert ask('"deep" [pos="NOUN"] "."') == [(11, 14)]
    assert ask('[pos="PUNCT"] [lemma=/^(a|rain)$/]') == [(5, 7), (13, 15)]  # from one sentence into the next
    assert ask('[pos="PUNCT"] [lemma=/^(a|rain)$/] within s') == []
    assert ask('[pos="ADV"] [] [pos="NOUN"]') == [(20, 23)]
    assert len(ask("[] []")) == 25


def test_repetition(ask):
    assert ask('[pos="ADJ"]+ [pos="NOUN"]') == [(1, 4), (2, 4), (11, 13), (16, 18), (21, 23)]
    assert ask('[pos="ADJ"]+') == ask('[pos="ADJ"]*') == [(1, 2), (1, 3), (2, 3), (11, 12), (16, 17), (19, 20), (21, 22)]
    assert ask('[pos="NUM"] [pos="ADJ"]{2}') == ask('[pos="NUM"] [pos="ADJ"]{2,}') == [(0, 3)] and ask('[pos="NUM"] [pos="ADJ"]{3,9}') == []
    assert ask('[pos=/^(ADJ|ADV)$/]{2,3} "boats"') == [(19, 23), (20, 23)]
    for none in ("{0}", "{7,3}", "{101}"):
        assert ask(f'[pos="ADJ"]{none}') == []
    assert ask('[lemma="rain"] []{1,2} [pos="NOUN"]') == [(14, 18)] and ask('[lemma="rain"] []* [lemma="new"]') == [(14, 20)]


def test_alternatives_and_groups(ask):
    assert ask('"Rain" | [pos="NUM"] | [lemma="near"]') == single(0, 10, 14)
    assert ask('[pos="CCONJ"] ([pos="ADJ"] | "zzz")') == [(18, 20)]
    assert ask('[pos="ADJ"] [pos="NOUN"] | [pos="DET"]') == single(2, 6, 11, 16, 21)  # several tokens count by their starts
    assert ask('([pos="ADJ"] [pos="NOUN"]) [pos="NOUN"]') == [(2, 4), (11, 13), (16, 18), (21, 23)]
    assert ask('([pos="ADV"] | [pos="ADJ"])+ [lemma="boat"]') == [(16, 18), (19, 23), (20, 23), (21, 23)]


def test_filters(ask):
    assert ask('[pos="DET"] within chapter') == single(6)  # an unknown layer doesn't limit
    assert ask('[pos="DET"] within component:birds') == []
    assert len(ask("[] within doc:pond")) == 26 and ask('[] within doc:"lake"') == []


def test_conditions(ask):
    assert ask('a:[pos="NOUN"] []{2,4} b:[pos="NOUN"] within s :: a.lemma = b.lemma') == [(17, 23)]
    assert ask('a:[pos="NOUN"] []{2,4} b:[pos="NOUN"] within s :: a.lemma != b.lemma') == [(7, 13)]
    assert ask('a:[pos="ADV"] [] b:[pos="NOUN"] :: distance(a,b) = 1 & distance(b,a) < 1') == [(20, 23)]
    assert ask('a:[pos="ADV"] [] b:[pos="NOUN"] :: distance(a,b) > 1') == []
    assert ask("a:[] :: a.feats = a.feats") == []  # no value is equal to none
    assert ask('(a:[pos="DET"]) [pos="NOUN"] :: a.word = a.word') == [(6, 8)]
    assert ask('([pos="NUM"] | a:[pos="DET"]) [] :: a.word = a.word') == []  # a label within a group is lost


def test_documents(spark):
    c = cached(CorpusBuilder(spark, "two").add_document("u", tags("X Y", "Z")).add_document("v", tags("X Z")).build())
    assert spans(c, '[pos="Z"] [pos="X"]') == [(2, 4)] and spans(c, '[pos="Z"] [pos="X"] within doc') == []
    assert spans(c, '[pos="Z"] [pos!="Y"]') == spans(c, '[pos="Z"] []') == []
    assert spans(c, "[] within doc:v") == single(3, 4)


def test_left_out_first_step(spark):
    c = cached(CorpusBuilder(spark, "e").add_document("d", tags("B B A B C B B B")).build())
    q = '[pos="A"]? [pos="B"]'
    assert spans(c, q) == [(0, 1), (2, 4), (3, 4), (5, 6)]
    assert spans(c, q, options=Options("standard")) == sorted([(2, 4), *single(0, 1, 3, 5, 6, 7)])
    assert spans(c, '[pos="A"]? [] [pos="C"]') == [(2, 5)]  # any token is one run, so without A only the beginning is tried
    assert spans(c, '[pos="A"]? [] [pos="B"]') == [(0, 2)]


def test_captures(herons, ask):
    hits = run(herons, '[pos="NUM"] x:[pos="ADJ"]* y:[pos="NOUN"]')
    assert captures(hits) == ["x", "y"]
    assert [(r.start_pos, r.end_pos, r.cap_x_start, r.cap_x_end, r.cap_y_start) for r in hits.collect()] == [(0, 4, 1, 3, 3)]
    empty = run(herons, '[pos="DET"] x:[pos="ADJ"]* y:[pos="NOUN"]').first()
    assert (empty.cap_x_start, empty.cap_x_end) == (7, 7)
    assert ask('[pos="DET"] x:[pos="ADJ"]* y:[pos="NOUN"] :: x.lemma = y.lemma') == [(6, 8)]  # no width reads the token there


@pytest.mark.parametrize("q", """[pos="N" | [pos] | [pos="N] | [pos=/N] | [pos=N] | "open | loose | sent:[] | []{ | []{x} | []{2 | []+* | [] ! | ( ) | [] within | [] within component | [] within component b | [] :: q.w | [] =x> | [] =x-y=> | [] =x=> component:b | q:[] :: q.word = q.word within s | q:[] :: q.word < q.lemma | q:[] :: distance(q,q) 1 | [] ] | q:[] q:[] | "b" & "c" """.split(" | "))
def test_refused(q):
    with pytest.raises(ParseError):
        cql.parse(q.strip())


@pytest.mark.parametrize("q", ["", "[", "[] |", "[] within s | []", "q:[] | q:[]"])
def test_refused_beginnings(q):
    with pytest.raises(ParseError):
        cql.parse(q)


def test_trees():
    verb = lambda: cql.Test("upos", True, "VERB")
    assert cql.parse('[pos="VERB" & feats.Mood!=/^I\\/n/]') == cql.Token((verb(), cql.Test("feats.Mood", False, "^I\\/n", True)))
    assert cql.parse('[word="say \\"no\\""]') == cql.Token((cql.Test("word", True, 'say \\"no\\"'),))
    assert cql.parse('k:[]{3,} [pos="VERB"]') == cql.Sequence((cql.Repeat(cql.Label("k", cql.Token()), 3, None), cql.Token((verb(),))))
    assert cql.parse('("x" | [pos="VERB"])?') == cql.Repeat(cql.Alternatives((cql.Token((cql.Test("word", True, "x"),)), cql.Token((verb(),)))), 0, 1)
    t = cql.parse('k:[] within doc within component:"b c",d =links=> within s :: k.pos != k.xpos & distance(k,k) <= 2')
    assert t == cql.Conditions(cql.WithinSpan(cql.Project(cql.WithinComponent(cql.WithinSpan(cql.Label("k", cql.Token()), "document"), ("b c", "d")), "links"), "sentence"), (cql.Same(("k", "upos"), ("k", "xpos"), False), cql.Distance("k", "k", "<=", 2)))
    assert cql.in_component(t, ("d",)).tests == t.tests
    with pytest.raises(UnknownLabel):
        cql.parse("k:[] :: m.word = k.word")
    assert cql.parse("distance:[] within p") == cql.WithinSpan(cql.Label("distance", cql.Token()), "paragraph")


def test_errors(herons, ask):
    for q in ("[word=/[/]", "[word=/(?=x)/]", "[word=/(a)\\1/]"):
        with pytest.raises(ExecutionError):
            run(herons, q)
    with pytest.raises(UnknownAlignment):
        run(herons, "[] =x=>")
    # within a sequence a faulty expression makes its whole step match nothing
    assert ask('[lemma=/[/] [pos="NOUN"]') == ask('([lemma=/[/] | [pos="ADJ"]) [pos="NOUN"]') == ask('[lemma!=/(?=x)/]{1,2} [pos="NOUN"]') == []


QUERIES = [
    '[pos="ADJ"]? [pos="NOUN"]', '[pos="ADV"]? [pos="ADJ"]* [pos="NOUN"]', '[pos!="PUNCT"]{2,4} "."', '([pos="DET"] | [pos="ADJ"] | [pos="NUM"])+ [pos="NOUN"] [pos!="ADV"]', '[]{0,3} [pos="VERB"]', '[pos="NOUN"] []* [pos="VERB"] within s',
    '([pos="ADJ"] [pos="NOUN"])? [pos="NOUN"]', '[pos="PUNCT"] ([] [pos="NOUN"])', '(([pos="ADJ"] | [pos="ADV"]) [])+ [pos="NOUN"] within doc', '[pos="NOUN"] [pos="PUNCT"]? [pos="ADJ"]{0,2}', '[pos=/^[AN]/] [pos=/^[AN]/] | [pos="CCONJ"] []',
]


@pytest.mark.parametrize("q", QUERIES)
def test_composed(spark, herons, q):
    assert spans(herons, q) == sorted(brute.spans(cql.parse(q), brute.read([HERONS])))


def test_random_patterns(spark):
    rng = random.Random(12)
    docs = [[" ".join(f"w/l/{rng.choice('ABC')}" for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))] for _ in range(10)]
    b = CorpusBuilder(spark, "r")
    for i, d in enumerate(docs):
        b.add_document(f"d{i}", conllu(d))
    corpus, toks = cached(b.build()), brute.read(docs)

    def token():
        allowed = "".join(sorted(rng.sample("ABC", rng.randrange(1, 4))))
        return "[]" if allowed == "ABC" else rng.choice([f"[pos=/^[{allowed}]$/]", f'[pos!="{(set("ABC") - set(allowed)).pop()}"]' if len(allowed) == 2 else f'[pos="{allowed[0]}"]'])

    def part(deep):
        if deep and rng.random() < 0.25:
            return "(" + rng.choice([" | ", " "]).join(part(False) for _ in range(2)) + ")" + rng.choice(["", "+", "?"])
        return token() + rng.choice(["", "", "?", "*", "+", "{2,3}", "{0,2}"])

    for _ in range(45):
        q = " ".join(part(True) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", " within s", " within doc"])
        assert spans(corpus, q) == sorted(brute.spans(cql.parse(q), toks)), q
