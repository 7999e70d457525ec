import pytest

from corpusq.__main__ import main
from tests.test_operators import folder  # noqa: F401


@pytest.fixture(scope="module")
def out(spark, folder, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("cli") / "c")
    assert main(["build", str(folder / "corpus.toml"), path]) == 0
    return path


CASES = [
    (["count", "C", '[pos="NOUN"]'], ["6"]), (["count", "C", '[pos="NOUN"]', "--component", "fr"], ["3"]), (["count", "C", '[pos="NOUN"]', "--document", "phare"], ["1"]), (["query", "C", "a:[] :: a.lemma = a.lemma", "--component", "fr", "--count-only"], ["16"]),
    (["count", "C", '[pos="NOUN"]', "--by", "document"], ["en\tharbour.conllu\t1", "en\torchard.conllu\t2", "fr\tmoulin.conllu\t2", "fr\tphare.conllu\t1"]),
    (["count", "C", '[pos="NOUN"]', "--by", "component"], ["en\t3", "fr\t3"]), (["query", "C", '[lemma="wind"]'], ["harbour.conllu\t1\tthe >>> wind <<< sleeps . it returns ."]),
    (["query", "C", '[pos="VERB"]', "--limit", "1"], ["harbour.conllu\t2\tthe wind >>> sleeps <<< . it returns . the"]), (["vocab", "C", "pos", "--document", "phare"], ["DET", "NOUN", "PRON", "PUNCT", "VERB"]),
    (["docs", "C", "--component", "fr"], ["fr\tmoulin.conllu", "fr\tphare.conllu"]), (["components", "C"], ["en\t", "fr\tfr"]), (["layers", "C"], ["word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps"]),
]


@pytest.mark.parametrize("args,want", CASES)
def test_commands(out, capsys, args, want):
    assert main([out if a == "C" else a for a in args]) == 0
    assert capsys.readouterr().out.splitlines() == want


def test_errors(out, folder, capsys):  # noqa: F811
    assert main(["build", str(folder / "corpus.toml"), out]) == 1
    assert main(["docs", out, "--component", "x"]) == 1 and main(["query", out, "["]) == 1
    assert "1104" in capsys.readouterr().err
    assert main(["info", out]) == 0
    assert "token_count\t32" in capsys.readouterr().out
