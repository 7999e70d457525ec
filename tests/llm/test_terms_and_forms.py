"""Burst-trie counting, consistent forms and content scores: against brute force and held-out cases."""

import random
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusq.llm import abuse, burst_trie, lookalikes
from corpusq.llm.burst_trie import BurstTrie, route_of, term_frequencies, verdicts
from corpusq.llm.lookalikes import SpellingTrie, by_table, canonical_forms, skeleton


def test_trie_counts_and_bursts():
    rng = random.Random(1)
    trie, want = BurstTrie(capacity=8), defaultdict(lambda: [0, 0])
    for _ in range(5000):
        t = "".join(rng.choice("abé𝒳") for _ in range(rng.randrange(0, 7)))
        trie.add(t, 3, 1)
        want[t][0] += 3
        want[t][1] += 1
    got, prefixes = {}, []
    for prefix, node in trie.containers():
        assert all(t.startswith(prefix) for t in node)
        prefixes.append(prefix)
        assert not set(got) & set(node)
        got |= node
    assert got == {t: tuple(n) for t, n in want.items()}
    assert len(prefixes) > 20 and max(map(len, prefixes)) > 1


def test_route():
    burst = {"": 5, "a": 3, "ab": 2}
    assert [route_of(x, burst) for x in ("abc", "ab", "ax", "b", "", "a")] == ["abc", "ab", "ax", "b", "", "a"] and route_of("abc", {}) == ""


def brute_counts(rows):
    pos, rec = Counter(), defaultdict(set)
    for layer, term, d in rows:
        if term is not None:
            pos[layer, term] += 1
            rec[layer, term] |= {d} - {None}
    return {k: (n, len(rec[k])) for k, n in pos.items()}


def test_a_task_adds_up_and_hands_on(monkeypatch):
    """Small steps and tries: states of a record in several batches, subtrees handed on before the end."""
    monkeypatch.setattr(burst_trie, "STEP_ROWS", 5)
    monkeypatch.setattr(burst_trie, "HELD_TERMS", 3)
    rng = random.Random(2)
    rows = sorted([("w", "", 0, rng.choice("abcdef"), rng.choice([None, 1, 2, 3]), 1) for _ in range(200)], key=lambda r: (r[4] is not None, r[4] or 0))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 3]), burst_trie._STATES)], schema=burst_trie._STATES) for i in range(0, 200, 3)]
    out = list(burst_trie._count(iter(batches)))
    merged = list(burst_trie._merge(iter(out)))
    assert len(out) > 1 and {(t, p, n) for b in merged for _, t, p, n in zip(*[c.to_pylist() for c in b.columns])} == {(t, n, r) for (_, t), (n, r) in brute_counts([(r[0], r[3], r[4]) for r in rows]).items()}


@pytest.mark.parametrize("share", [1 / 64, 1 / 3, 1 / 2000])
def test_frequencies(spark, monkeypatch, share):
    monkeypatch.setattr(burst_trie, "SHARE", share)
    rng = random.Random(4)
    word = lambda: rng.choice([None, "", "the", "the", "the", "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))])
    rows = [(rng.choice(["w", "l"]), word(), rng.choice([None, 1, 2, 3, 4])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "layer string, term string, d int")
    got = term_frequencies(df, "d")
    assert {(r.layer, r.term): (r.n_positions, r.n_records) for r in got.collect()} == brute_counts(rows)
    assert term_frequencies(df.limit(0), "d").count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([("w", "a", 2, 2), ("w", "b", 9, 2), ("w", "c", 3, 1)], "layer string, term string, n_positions long, n_records long")
    assert {r.term: r.verdict for r in verdicts(df, 3).collect()} == {"a": "rare", "b": "common", "c": None}


FORMS = {
    "тһе": "the", "th​e": "the", "\xa0the": "the", "ｔｈｅ": "the", "the": "the", "жизнь": "жизнь", "Ωmega": "Ωmega", "m²": "m²", "3º": "3º", "d̂ola": "d̂ola",
    "café": "café", "ﬁeld": "field", "Port X": "Port X", "œuvre": "œuvre", "​": "", "": "", "Kelvin": "Kelvin", "’tis": "’tis", "ＡＢ１": "AB1",
    "Έl": "Él", "жи​знь": "жизнь", "ßen": "ßen", "Łódka": "Łódka", "нос": "нос",
}


def test_table_forms():
    for text, form in FORMS.items():
        assert by_table(text) == ({"тһе": "тһе"}.get(text, form)), text  # т is no look-alike in lower case


def test_automaton():
    trie = SpellingTrie()
    for w, n in (("Il", 5), ("ll", 9), ("the", 50), ("café", 3), ("San X", 1)):
        trie.add(w, n)
    match = lambda t, b=0.0: (trie.nearest(t, b) or (0, None))[1]
    assert match("Іl") == "ll"  # looks like both, the more frequent one
    assert match("tһе​") == "the" and match("ｃａｆｅ́") == "café" and match("\xa0San X") == "San X"
    assert match("жук") is None and match("thx") is None and match("thx", 1) == match("thee", 1) == match("te", 1) == match("he", 1) == "the" and match("xxe", 1) is None
    assert skeleton("Іl") == skeleton("Il") == skeleton("ll")
    trie.add("Ionic", 2)
    assert lookalikes.canonical("Ӏоnics", trie) == "Ionics" and by_table("Ӏоnics") == "Ionics" and lookalikes.canonical("ӏоnics", trie) == "Ionics"
    trie.add("Ilex", 2)
    assert lookalikes.canonical("ӏlexa", trie) == "Ilexa" and by_table("ӏlexa") == "llexa"  # the nearest spelling tells which letter it is


def test_words_of_other_alphabets():
    trie = SpellingTrie()
    for w in ("y", "the", "cop"):
        trie.add(w, 1)
    form = lambda t: lookalikes.canonical(t, trie)
    for word in ("сухо", "ухо", "хор", "οικια", "о", "рука", "Ἀθήνα"):
        assert form(word) == unicodedata.normalize("NFC", word) and by_table(word) == unicodedata.normalize("NFC", word)
    assert form("у") == "y" and form("сор") == "cop"  # a plain spelling looks the same
    cyr = SpellingTrie("CYRILLIC")
    cyr.add("сухо", 3)
    assert lookalikes.canonical("cyxo", cyr) == "сухо" and lookalikes.canonical("cухa", cyr) == "суха" and lookalikes.canonical("water", cyr) == "water"


def test_forms_within_component(spark):
    rows = [("en", "the", 9), ("en", "tһe", 1), ("fr", "tһe", 1), ("en", None, 3), (None, "ｘ", 1), (None, "x", 4), ("en", "жизнь", 2), ("en", "x" * 5000 + "​", 1)]
    df = spark.createDataFrame(rows, "comp string, term string, n long")
    got = {(r.comp, r.term): r.canonical for r in canonical_forms(df).collect()}
    assert got == {("en", "the"): "the", ("en", "tһe"): "the", ("fr", "tһe"): "the", (None, "ｘ"): "x", (None, "x"): "x", ("en", "жизнь"): "жизнь", ("en", "x" * 5000 + "​"): "x" * 5000}
    assert canonical_forms(df.limit(0)).count() == 0
    other = spark.createDataFrame([("ru", "вода и хлеб", 9), ("ru", "хлеб", 4), ("ru", "xлеб", 1), ("ru", "ok", 1), ("el", "λόγος", 5), ("el", "λόγoς", 1), ("en", "bread", 3)], "comp string, term string, n long")
    assert lookalikes.alphabets(other) == {"ru": "CYRILLIC", "el": "GREEK"}
    assert {(r.comp, r.term): r.canonical for r in lookalikes.canonical_table(other).collect()} == {("ru", "xлеб"): "хлеб", ("el", "λόγoς"): "λόγος"}
    plain = spark.createDataFrame([(x,) for x in FORMS], "t string").select("t", lookalikes.suspect("t").alias("s"))
    assert all(r.s or by_table(r.t) == r.t for r in plain.collect())


def corpus(rng, n):
    kind = ["You worthless {} ruined it", "I will break your {} today", "Go and drown, {} fool"]
    good = ["The {} crosses the garden", "He compares the {} with a book", "I break the bread of {}", "The fool in the tale of {} sings"]
    name = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("nrst")
    docs = []
    for _ in range(n):
        bad = rng.random() < 0.3
        s = [rng.choice(good).format(name()) + rng.choice(".!?") for _ in range(rng.randrange(1, 6))]
        if bad:
            s.insert(rng.randrange(len(s) + 1), rng.choice(kind).format(name()) + ".")
        docs.append((rng.choice(["\n", " "]).join(s), int(bad)))
    return docs


def test_held_out_accuracy_and_disguises():
    rng = random.Random(6)
    seen, held = corpus(rng, 600), corpus(rng, 300)
    labels = [y if rng.random() > 0.03 else 1 - y for _, y in seen]
    w = abuse.fit([t for t, _ in seen], labels)
    s = abuse.document_scores(w, [t for t, _ in held])
    assert sum((x >= 0.5) == bool(y) for x, (_, y) in zip(s, held, strict=True)) >= 290
    for text in ("You w o r t h l e s s ban ruined it.", "YOU WORTHLE55 BAN RUINED IT!", "You wοrtһlеѕs ban ru​ined it", "You worthlesssss ban ruined it"):
        assert abuse.document_scores(w, [text])[0] >= 0.5, text
    assert list(abuse.document_scores(w, [None, "", "\n", "..."])) == [0, 0, 0, 0]


def test_wrong_judgements_are_not_learnt_by_heart():
    rng = random.Random(12)
    words = [a + b for a in ("gar", "tol", "mer", "vin", "sed", "pol", "dak", "hul") for b in ("den", "sk", "ral", "lu", "pex")]
    docs = [(". ".join([t, *(" ".join(["the", *rng.choices(words, k=5)]) for _ in range(3))]), y) for t, y in corpus(rng, 900)]
    wrong = set(rng.sample([i for i, (_, y) in enumerate(docs) if not y], 60))
    s = abuse.document_scores(abuse.fit([t for t, _ in docs], [int(y or i in wrong) for i, (_, y) in enumerate(docs)]), [t for t, _ in docs])
    assert sum(s[i] >= 0.3 for i in wrong) <= 12
    bad = [i for i, (_, y) in enumerate(docs) if y]
    assert sum(s[i] >= 0.3 for i in bad) >= 0.98 * len(bad)
    harmless = [t for t, y in docs if not y]  # nobody else to ask: the only judgement of its kind counts
    only = abuse.fit([*harmless, "You worthless ban ruined it."], [0] * len(harmless) + [1])
    assert abuse.document_scores(only, ["You worthless ban ruined it."])[0] >= 0.3


def test_scoring_and_training(spark):
    rng = random.Random(9)
    docs = [(i, t, y) for i, (t, y) in enumerate(corpus(rng, 300))]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = [(i, y, "r") for i, _, y in docs] + [(1, 1 - docs[1][2], "q"), (None, 1, "r"), (2, None, "r")]
    lab = spark.createDataFrame(labels, "doc_id long, abusive int, rater string")
    assert {r.doc_id for r in abuse.majority(lab).collect()} == {i for i, *_ in docs} - {1}
    w = abuse.train(df, lab)
    got = {r.doc_id: r.score for r in abuse.score_documents(df, w).collect()}
    assert len(got) == 303 and got[1000] == got[1001] == 0
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in docs) >= 290
    assert not abuse.train(df, lab.limit(0)).any()
    with pytest.raises(ValueError):
        abuse.score_documents(df.withColumn("score", F.lit(1)), w)
    long = "The garden crosses. " * 200_000 + "You worthless ban ruined it."
    assert abuse.document_scores(w, [long])[0] == abuse.document_scores(w, ["You worthless ban ruined it."])[0]
