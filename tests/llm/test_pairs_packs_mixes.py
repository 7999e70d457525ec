"""Alignment, packing and mixing: against brute force and constructed truths."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import align, mixing, packing, sizes

EN = "the cat house river moon king bread stone garden tower horse letter wolf ship road song bell lamp coat rain".split()
ES = {w: w[::-1] + "o" for w in EN}


def bilingual(rng, n_docs, n_sent, names=True):
    """tokens, docs, true (source sentence, target sentence) pairs; target sentences are shuffled, dropped and joined."""
    tok, docs, truth, pos, sid = [], [], set(), 0, 0
    name = lambda: "N" + "".join(rng.choice("aeioubdg") for _ in range(6))

    def emit(comp, doc, nr, clauses):
        nonlocal pos, sid
        for k, c in enumerate(clauses):
            for word in ([("and", "CCONJ")] if k else []) + c:
                tok.append((pos, comp, doc, sid, nr, word[0], word[0] if word[1] == "NOUN" else None, word[1]))
                pos += 1
        sid += 1
        return sid - 1

    for d in range(n_docs):
        src, order = [], []
        for i in range(n_sent):
            words = rng.sample(EN[1:], 4)
            src.append((words, [name()] if names and rng.random() < 0.7 else []))
        docs += [(2 * d, d, "es", f"P{d}"), (2 * d + 1, d, "en", f"P{d}")]
        a_ids = [emit("es", 2 * d, i, [[(ES[w], "NOUN") for w in ws] + [(x, "PROPN") for x in ns]]) for i, (ws, ns) in enumerate(src)]
        order = [i for i in range(n_sent) if rng.random() > 0.1]
        if len(order) > 4:
            i = rng.randrange(len(order) - 3)
            order[i], order[i + 2] = order[i + 2], order[i]
        nr = 0
        while order:
            part = [order.pop(0) for _ in range(min(len(order), 1 if rng.random() < 0.8 else 2))]
            b = emit("en", 2 * d + 1, nr, [[(w, "NOUN") for w in src[i][0]] + [(x, "PROPN") for x in src[i][1]] for i in part])
            truth |= {(a_ids[i], b) for i in part}
            nr += 1
    return tok, docs, truth


TOK = "pos long, comp string, doc_idx int, sent_idx int, sent_in_doc int, word string, lemma string, upos string"


@pytest.mark.parametrize("block", [1024, 12])
def test_alignment(spark, block):
    tok, docs, truth = bilingual(random.Random(3), 12, 20)
    t = spark.createDataFrame(tok + [(10**6, "es", None, 1, 0, "x", "x", "NOUN"), (10**6 + 1, "es", 999, 10**6, 0, None, None, None)], TOK)
    d = spark.createDataFrame(docs + [(999, 99, "es", None)], "doc_idx int, doc_in_comp int, comp string, pair_key string")
    m = spark.createDataFrame([("s", "es", "en"), ("none", None, "en")], "align_name string, source_component string, target_component string")
    got = {(r.sent_a, r.sent_b) for r in align.align_sentences(t, d, m, block).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > (0.95 if block > 100 else 0.9)
    assert align.align_sentences(t.limit(0), d, m).count() == 0
    assert align.align_sentences(t, d.limit(0), m).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_change_nothing(spark, block):
    """Divided, joined and moved sentences, repeated ones, and merges over the edges of blocks."""
    tok, docs, _ = bilingual(random.Random(8), 4, 30)
    rng = random.Random(9)
    tok = [x[:6] + ((None, "NOUN") if x[7] == "CCONJ" and rng.random() < 0.5 else x[6:]) for x in tok]  # joined without a tag
    again = {x[3] for x in tok if x[4] in (4, 5)}
    tok += [(x[0] + 10**6, x[1], x[2], x[3] + 10**5, x[4] + 40, *x[5:]) for x in tok if x[3] in again]
    t = spark.createDataFrame(tok, TOK)
    d = spark.createDataFrame(docs, "doc_idx int, doc_in_comp int, comp string, pair_key string")
    m = spark.createDataFrame([("s", "es", "en")], "align_name string, source_component string, target_component string")
    whole, cut = ({(r.sent_a, r.sent_b): round(r.similarity, 3) for r in align.align_sentences(t, d, m, n).collect()} for n in (1024, block))
    assert len(whole) > 100 and cut == whole


def test_joined_without_conjunction():
    """1:2 and 2:1, with and without one half that is found by its clause."""
    words = [2 * i for i in range(40)]
    side = align.Side(align.Rows(np.array(words), 1), np.ones(41), np.arange(40), np.eye(40, dtype=np.float32))
    model = side, side
    sentence = lambda i, *parts: (i, i, [words[a:b] for a, b in parts])
    two = [sentence(0, (0, 5)), sentence(1, (5, 10)), sentence(2, (20, 24)), sentence(3, (30, 32))]
    for n in (4, 5, 7):
        one = [sentence(10, (0, 10)), sentence(12, (20, 24))]
        two[:2] = sentence(0, (0, n)), sentence(1, (n, 10))
        assert set(align.match(one, two, model)) == {(0, 0), (0, 1), (1, 2)}
        assert set(align.match(two, one, model)) == {(0, 0), (1, 0), (2, 1)}


def test_terms_without_a_row_of_their_own(spark, monkeypatch):
    """Sentences of rare lemmas that are equal in both languages, cut or not; then lemmas that differ, all of shared rows."""
    rare = [[f"rare{4 * i + k}" for k in range(4)] for i in range(9)]
    tok = [(100 * i + k + 10_000 * side, comp, side, i + 20 * side, i, w, w, "NOUN") for side, comp in enumerate(("es", "en")) for i, ws in enumerate(rare) for k, w in enumerate(["el" if side == 0 else "it", *ws])]
    t = spark.createDataFrame(tok, TOK)
    d = spark.createDataFrame([(0, 0, "es", "P"), (1, 0, "en", "P")], "doc_idx int, doc_in_comp int, comp string, pair_key string")
    m = spark.createDataFrame([("s", "es", "en")], "align_name string, source_component string, target_component string")
    monkeypatch.setattr(align, "OWN_ROWS", 1)
    for block in (1024, 4):
        assert {(r.sent_a, r.sent_b) for r in align.align_sentences(t, d, m, block).collect()} == {(i, i + 20) for i in range(9)}
    tok, docs, truth = bilingual(random.Random(3), 12, 20)
    d = spark.createDataFrame(docs, "doc_idx int, doc_in_comp int, comp string, pair_key string")
    got = {(r.sent_a, r.sent_b) for r in align.align_sentences(spark.createDataFrame(tok, TOK), d, m).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95


def test_decomposition_is_that_of_the_whole_table(spark):
    """Distributed passes against numpy: similarities of all rows."""
    rng = np.random.default_rng(2)
    c = rng.integers(0, 2, (30, 20)) * rng.integers(1, 9, (30, 20)) * align.COUNT_UNIT
    s, t = np.nonzero(c)
    df = spark.createDataFrame([("k", "a", "b", int(i), int(j), int(c[i, j])) for i, j in zip(s, t)], align._COUNTS_SQL)
    x, y = align.Decomposition(df).vectors(8)["k", "a", "b"]
    n = c / align.COUNT_UNIT
    r, q = n.sum(1), n.sum(0)
    u, sv, vt = np.linalg.svd((n - np.outer(r, q) / n.sum()) / np.sqrt(np.outer(r + 1, q + 1)))
    root = np.sqrt(sv[:8])
    want = align._unit(u[:, :8] * root) @ align._unit(vt[:8].T * root).T
    assert np.abs(x @ y.T - want).max() < 0.02


def test_hand_made(spark):
    d = spark.createDataFrame([(0, 0, "es", "P"), (1, 0, "en", "P"), (2, 1, "en", "Q")], "doc_idx int, doc_in_comp int, comp string, pair_key string")
    m = spark.createDataFrame([("s", "es", "en")], "align_name string, source_component string, target_component string")
    s = spark.createDataFrame([(10, 0, 0), (11, 0, 1), (12, 1, 0), (13, 2, 0)], "sent_idx int, doc_idx int, sent_in_doc int")
    e = spark.createDataFrame([("s", 0, 1, 0, 0), ("s", 0, 1, 0, 0), ("s", 0, 9, 0, 0), ("s", 0, 0, 1, 0), ("x", 0, 0, 0, 0)], "align_name string, src_doc int, src_sent int, tgt_doc int, tgt_sent int")
    assert [tuple(r) for r in align.hand_made(e, d, s, align.document_pairs(d, m)).collect()] == [("s", 11, 12)]


def test_terms():
    assert align.term_of("9,551", "@card@", "NUM") == align.term_of("9.551", "@card@", "NUM") == "=9551"
    assert align.term_of("Kаl", "<unknown>", "PROPN") == "=kal" and align.term_of("the", "the", "DET") is None
    assert align.term_of("and", "and", "CCONJ") == "" and align.term_of("rivers", None, "NOUN") == "rivers" and align.term_of(None, None, None) is None


def test_best_fit_decreasing_against_simple():
    rng = random.Random(1)
    for capacity in (10, 100, 100_000):
        for _ in range(40):
            s = np.array([rng.randrange(0, capacity + 1) for _ in range(rng.randrange(0, 60))], np.int64)
            bins = packing.best_fit_decreasing(s, capacity)
            rooms: list[int] = []
            for x in sorted(s.tolist(), reverse=True):
                fits = [r for r in rooms if r >= x]
                if fits:
                    rooms.remove(min(fits))
                    rooms.append(min(fits) - x)
                else:
                    rooms.append(capacity - x)
            used = np.bincount(bins, s) if len(s) else np.zeros(0)
            assert sorted(capacity - used) == sorted(rooms)


def optimum(s, capacity):
    s = sorted(s, reverse=True)
    for n in itertools.count(0):
        def place(i, rooms):
            if i == len(s):
                return True
            seen = set()
            for k, r in enumerate(rooms):
                if r >= s[i] and r not in seen:
                    seen.add(r)
                    if place(i + 1, rooms[:k] + (r - s[i],) + rooms[k + 1 :]):
                        return True
            return False

        if place(0, (capacity,) * n):
            return n


def test_bounds_never_exceed_optimum():
    rng = random.Random(2)
    tight = 0
    for _ in range(150):
        s = [rng.randrange(1, 21) for _ in range(rng.randrange(0, 9))]
        b, best = packing.bound(packing.function_sums(np.array(s, np.int64), 20), 20), optimum(s, 20)
        assert b <= best
        tight += b == best
    assert tight > 120


@pytest.mark.parametrize("per_part", [20_000, 25])
def test_pack(spark, per_part):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 7, 60, 99, 100, 101, 250, rng.randrange(1, 100)])) for i in range(300)] + [(7, 33), (None, 40), (400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    specs = spark.createDataFrame([("a", 100), ("b", 64), ("zero", 0), (None, 5)], "spec_name string, capacity_tokens int")
    out = packing.pack(docs, specs, per_part).collect()
    least = packing.lower_bounds(packing.items_of(docs, specs))
    for spec, cap in (("a", 100), ("b", 64)):
        mine = [r for r in out if r.spec_name == spec]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in rows)
        assert {r.doc_id for r in mine} == {i for i, _ in rows}
        used: dict[str, int] = {}
        for r in mine:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
            assert r.start == r.piece * cap
        assert max(used.values()) <= cap and least[spec] <= len(used) <= least[spec] * 1.1 + 2
        whole = {i for i, n in rows if (n or 0) <= cap} - {7}
        assert all(r.piece == 0 for r in mine if r.doc_id in whole)
    assert packing.pack(docs.limit(0), specs).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a b c", "kept"), (2, "", None), (3, None, None), (4, "<|endoftext|>", None)], "doc_id long, text string, note string")
    got = {r.doc_id: r.n_tokens for r in sizes.with_sizes(df).collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 1
    assert sizes.with_sizes(df).columns == ["doc_id", "note", "n_tokens"]
    with pytest.raises(ValueError):
        sizes.with_sizes(df.withColumn("n_tokens", F.lit(1)))


def library(rng, n):
    words = {"tales": "wolf king forest dragon".split(), "forum": "query index layer token".split(), "songs": "la heart moon love".split()}
    rows = []
    for i in range(n):
        s = rng.choices(list(words), [6, 3, 1])[0]
        rows.append((i, None if rng.random() < 0.1 else s, " ".join(rng.choice(words[s]) for _ in range(rng.randrange(5, 60)))))
    return rows + [(n, "tales", ""), (n + 1, "songs", None), (n + 2, "none", "wolf")]


def test_mix(spark):
    rows = library(random.Random(4), 1500)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame(
        [("m", "tales", 0.5, 2, 0.4), ("m", "forum", 0.3, 2, 0.4), ("m", "songs", 0.2, 3, 0.4), ("short", "songs", 0.9, 1, 0.5), ("short", "gone", 0.1, 1, 0.5)],
        "mix_name string, source string, target_share double, max_repeats int, budget_ratio double",
    )
    drawn, mixes, domains = mixing.mix(docs, targets)
    got = drawn.collect()
    source = {i: s for i, s, _ in rows}
    cap = {("m", "tales"): 2, ("m", "forum"): 2, ("m", "songs"): 3, ("short", "songs"): 1}
    assert all(1 <= r.uses <= cap[r.mix_name, r.domain] for r in got)
    assert all(r.domain == source[r.doc_id] for r in got if source[r.doc_id])
    rep = {(r.mix_name, r.source): r for r in mixing.shares(drawn, mixes, domains).collect()}
    for s, want in (("tales", 0.5), ("forum", 0.3), ("songs", 0.2)):
        assert abs(rep["m", s].actual_share - want) < 0.005 and rep["m", s].target_met
    assert not rep["short", "songs"].target_met and rep["short", "songs"].tokens_without_source > 0 and rep["short", "gone"].tokens == 0
    model = mixing.fit_domains(docs, domains)
    held = library(random.Random(44), 300)
    p = model.posteriors([t for _, s, t in held if s in ("tales", "forum", "songs")])
    right = [domains[k] == s for k, s in zip(p.argmax(1), [s for _, s, _ in held if s in ("tales", "forum", "songs")], strict=True)]
    assert sum(right) > 0.95 * len(right)
    again, *_ = mixing.mix(docs.unionByName(docs.where("doc_id < 300")).unionByName(docs.where("doc_id < 300").withColumn("doc_id", F.lit(None).cast("long"))), targets)
    assert all(1 <= r.uses <= cap[r.mix_name, r.domain] for r in again.collect())
    rows_of = lambda df: sorted(map(tuple, mixing.mix(df, targets)[0].collect()))
    assert rows_of(docs.repartition(3, "text")) == rows_of(docs.repartition(7, "doc_id")) == sorted(map(tuple, got))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
    assert mixing.mix(docs, targets.limit(0))[0].count() == 0


def test_projection_against_many_small_steps():
    """Rates of mixed memberships: no feasible step makes the squared distance smaller."""
    rng = np.random.default_rng(3)
    member = np.vstack([np.eye(3), mixing.in_parts(rng.dirichlet([0.3] * 3, 40)) / mixing.GRID])
    size, own, caps = rng.integers(1, 50, 43).astype(float), np.arange(43) < 3, rng.integers(1, 4, 43).astype(float)
    target = np.array([200.0, 20.0, 0.0])
    r = mixing.project(member, size, own, target, caps)
    miss = lambda x: ((target - (x * size) @ member) ** 2).sum()
    assert (r >= 0).all() and (r <= caps).all()
    for _ in range(500):
        assert miss(r) <= miss(np.clip(r + rng.normal(0, 0.01, 43), 0, caps)) + 1e-3
    few = mixing.project(np.eye(2), np.array([10.0, 10.0]), np.ones(2, bool), np.array([15.0, 50.0]), np.array([2.0, 3.0]))
    assert np.allclose(few, [1.5, 3.0])


def test_one_size_for_all(spark):
    """Systematic selection where every document has the same size, and ids are repeated or missing."""
    rated = spark.createDataFrame([("m", i if i % 3 else None, "s", "s", 10, 0.4, i) for i in range(2000)], "mix_name string, doc_id long, source string, domain string, n_tokens long, rate double, row long")
    assert 795 <= sum(r.uses for r in mixing.systematic(rated).collect()) <= 805


def test_bounded_sample(spark):
    from corpusq.llm.samples import bounded_sample

    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(300)] + [(5, None), (None, "xx")], "doc_id long, text string")
    a, b = (sorted(r.doc_id or -1 for r in bounded_sample(d, "doc_id", "text", 100, 200).collect()) for d in (df, df.repartition(5)))
    assert a == b and 40 < len(a) <= 100 and sum(max(i, 0) % 7 for i in a) <= 200 and len(bounded_sample(df, "doc_id", "text", 10).collect()) == 10
