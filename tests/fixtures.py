"""Small corpora of invented sentences, written as word/lemma/TAG, and a builder of CoNLL-U text."""

#: Twenty-six tokens in four sentences: positions 0-5, 6-13, 14-15, 16-25.
HERONS = [
    "Seven/seven/NUM small/small/ADJ grey/grey/ADJ herons/heron/NOUN wait/wait/VERB ././PUNCT",
    "A/a/DET heron/heron/NOUN never/never/ADV hurries/hurry/VERB near/near/ADP deep/deep/ADJ water/water/NOUN ././PUNCT",
    "Rain/rain/NOUN !/!/PUNCT",
    "Old/old/ADJ boats/boat/NOUN or/or/CCONJ new/new/ADJ very/very/ADV light/light/ADJ boats/boat/NOUN drift/drift/VERB by/by/ADP slowly/slowly/ADV",
]
_NONE = "_\t_\t_\t_\t_\t_\t_\t_"


def _row(i, form, lemma="_", upos="_", feats="_", head="_", deprel="_", deps="_", misc="_"):
    return f"{i}\t{form}\t{lemma}\t{upos}\t_\t{feats}\t{head}\t{deprel}\t{deps}\t{misc}"


#: "Sale del molino y canta": a contraction over two words, then an empty node.
FUSED = "\n".join([
    "# sent_id = fused-1",
    _row(1, "Sale", "salir", "VERB", head="0", deprel="root"),
    _row("2-3", "del"),
    _row(2, "de", "de", "ADP", head="4", deprel="case"),
    _row(3, "el", "el", "DET", head="4", deprel="det", deps="4:det"),
    _row(4, "molino", "molino", "NOUN", "Gender=Masc|Number=Sing", "1", "obl"),
    _row(5, "y", "y", "CCONJ", head="6", deprel="cc"),
    _row("5.1", "ella", "ella", "PRON", deps="6:nsubj"),
    _row(6, "canta", "cantar", "VERB", head="1", deprel="conj", misc="SpaceAfter=No"),
    _row(7, "…", "…", "PUNCT", head="1", deprel="punct"),
]) + "\n"
#: "¡Nieva!" without blanks, and a contraction that is glued to the next word.
TIGHT = "\n".join([
    _row(1, "¡", "¡", "PUNCT", head="2", misc="SpaceAfter=No"),
    _row(2, "Nieva", "nevar", "VERB", head="zero", misc="Gloss=snows|SpaceAfter=No"),
    _row(3, "!", "!", "PUNCT", head="2"),
    "",
    _row("1-2", "kova-", misc="SpaceAfter=No"),
    _row(1, "ko", "ko", "PART", head="3"),
    _row(2, "va", "va", "DET", head="3"),
    _row(3, "lume", "lume", "NOUN", head="0"),
]) + "\n"


def conllu(sentences: list[str], ids: bool = True) -> str:
    """word/lemma/UPOS triples; xpos is the tag in lower case."""
    out = []
    for i, s in enumerate(sentences):
        rows = [t.rsplit("/", 2) for t in s.split()]
        head = [f"# sent_id = {i + 1}"] if ids else []
        out.append("\n".join([*head, *[f"{k + 1}\t{w}\t{lem}\t{u}\t{u.lower()}\t_\t0\tdep\t_\t_" for k, (w, lem, u) in enumerate(rows)]]))
    return "\n\n".join(out) + "\n"


def tags(*sentences: str) -> str:
    """A document of tags only; words are w0, w1 ..."""
    n = iter(range(10**6))
    return conllu([" ".join(f"w{(k := next(n))}/l{k}/{t}" for t in s.split()) for s in sentences])
