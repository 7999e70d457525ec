"""Visually identical text to one form.

Each group of strings (a component) has the alphabet that most of its letters are of. Its plain spellings lie in tries, one
for each beginning (by look), and every string that has anything but plain characters runs through the trie of its beginning
by a weighted edit automaton: look-alikes and ignorable characters cost nothing, any other difference costs 1. A spelling
reached at no cost is the canonical form (the most frequent, if several). One within the budget tells which of several
letters a look-alike stands for, no more. What comes near no spelling is normalized character by character from a table.
Words wholly of another alphabet keep their letters unless a plain spelling looks the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other alphabets by the Latin letters they look like (public Unicode confusables).
LOOKS_LATIN = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "lI", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "Il", "Ј": "J", "Ѕ": "S", "Һ": "h", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "Il", "Ү": "Y", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    # Latin letters outside the usual alphabets
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y",
}
_TAGS = {"<wide>", "<narrow>", "<font>"}
_IGNORED_ALSO = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
#: Characters of plain spellings; any other character, or a blank at an end, makes a string suspect.
PLAIN = r"^(?:[!-~¡¿«»À-ÖØ-öø-ÿŒœ–—…](?:[ -~¡¿«»À-ÖØ-öø-ÿŒœ–—…]*[!-~¡¿«»À-ÖØ-öø-ÿŒœ–—…])?)?$"


#: The same for groups of other alphabets.
PLAIN_OF = {"CYRILLIC": PLAIN.replace("!-~", "!-@\\[-`{-~Ѐ-ҁҊ-ԯ").replace(" -~", " -@\\[-`{-~Ѐ-ҁҊ-ԯ").replace("À-ÖØ-öø-ÿŒœ", ""), "GREEK": PLAIN.replace("!-~", "!-@\\[-`{-~Ͱ-Ͽἀ-῿").replace(" -~", " -@\\[-`{-~Ͱ-Ͽἀ-῿").replace("À-ÖØ-öø-ÿŒœ", "")}


def script_of(ch: str) -> str | None:
    """The alphabet of a letter, of those that are told apart; None for other characters."""
    if not ch.isalpha():
        return None
    code = ord(ch)
    if 0x370 <= code <= 0x3FF or 0x1F00 <= code <= 0x1FFF:
        return "GREEK"
    if 0x400 <= code <= 0x52F:
        return "CYRILLIC"
    return "LATIN" if (code < 0x250 or 0x1E00 <= code < 0x1F00) and ch not in LOOKS_LATIN else "OTHER"


def _inverse(script: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for ch, latin in LOOKS_LATIN.items():
        if script_of(ch) == script:
            for x in latin:
                out[x] = out.get(x, "") + ch
    return out


_LOOKS = {script: _inverse(script) for script in PLAIN_OF}


def _in_alphabet(ch: str, script: str) -> str:
    """The letters of an alphabet that a letter looks like; itself if none does."""
    if script == "LATIN":
        return LOOKS_LATIN.get(ch, ch)
    if script_of(ch) == script:
        return ch
    return "".join(dict.fromkeys("".join(_LOOKS[script].get(x, "") for x in LOOKS_LATIN.get(ch, ch)))) or ch


@lru_cache(65_536)
def options(ch: str, script: str = "LATIN") -> tuple[str, ...]:
    """What a character may stand for at no cost, first choice first; decomposed, as tries hold decomposed text."""
    code = ord(ch)
    if unicodedata.category(ch) == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in _IGNORED_ALSO:
        return ("",)
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\r\f\v\x85":
        return (" ",)
    tag, _, parts = unicodedata.decomposition(ch).partition(" ")
    flat = unicodedata.normalize("NFKD", ch)
    fused = tag == "<compat>" and ch.isalpha() and " " in parts and all(unicodedata.category(x)[0] in "LM" for x in flat)
    if tag in _TAGS or fused:
        looks = [_in_alphabet(x, script) for x in flat]
        return tuple(dict.fromkeys(x for x in looks[0])) if len(flat) == 1 else (flat,)
    return tuple(_in_alphabet(ch, script))


def _stripped(text: str) -> str:
    """Without blanks and ignorable characters at the ends."""
    a, b = 0, len(text)
    while a < b and options(text[a]) in (("",), (" ",)):
        a += 1
    while a < b and options(text[b - 1]) in (("",), (" ",)):
        b -= 1
    return text[a:b]


def _letters(text: str, script: str) -> tuple[bool, bool]:
    """Whether a string has a letter of another alphabet that looks like none of its group's, and whether it has nothing but
    letters of other alphabets."""
    unlike, own = False, False
    foreign = 0
    for c in unicodedata.normalize("NFKD", text):
        s = script_of(c)
        if s == script:
            own = True
        elif s is not None:
            foreign += 1
            unlike |= script_of(options(c, script)[0][:1] or c) != script
    return unlike, foreign > 0 and not own


def by_table(text: str, script: str = "LATIN") -> str:
    """The form by the table alone. Letters of another alphabet are replaced only beside letters of the group's own, and only
    if all of them look like such; else the string is taken for a word of that alphabet and keeps them."""
    kept = unicodedata.normalize("NFD", _stripped(text))
    unlike, alien = _letters(kept, script)
    keep = (lambda c: script_of(c) not in (None, script)) if unlike or alien else (lambda c: False)
    return unicodedata.normalize("NFC", "".join(c if keep(c) and unicodedata.decomposition(c).partition(" ")[0] not in _TAGS else options(c, script)[0] for c in kept))


#: Letters that look alike within the alphabet once another alphabet's letter stands for them.
_SAME_LOOK = str.maketrans({"I": "l"})


def skeleton(text: str, script: str = "LATIN") -> str:
    """Equal for strings that the automaton matches without paid edits."""
    return "".join(options(c, script)[0] for c in unicodedata.normalize("NFD", _stripped(text))).translate(_SAME_LOOK)


class SpellingTrie:
    """Plain spellings by decomposed characters; the empty key holds (frequency, spelling)."""

    def __init__(self, script: str = "LATIN") -> None:
        self.root: dict = {}
        self.script = script

    def add(self, spelling: str, frequency: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", spelling):
            node = node.setdefault(c, {})
        node[""] = max(node.get("", (0, spelling)), (frequency, spelling), key=lambda x: x[0])

    def nearest(self, text: str, budget: float = 1.0, edit_cost: float = 1.0) -> tuple[float, str, str] | None:
        """(cost, spelling, reading) of the spelling reached at the least cost within `budget`; among these the most frequent,
        then the least in order. `reading` is the text itself with the look-alikes as on the way to that spelling.

        Look-alikes, ignorable characters, width, composition and kinds of blanks cost nothing, any other replacement,
        insertion or deletion `edit_cost`.
        """
        states: dict[int, tuple[float, str, dict]] = {id(self.root): (0.0, "", self.root)}

        def reach(into: dict, node: dict | None, cost: float, read: str) -> bool:
            if node is not None and cost <= budget and (id(node) not in into or cost < into[id(node)][0]):
                into[id(node)] = cost, read, node
                return True
            return False

        def inserted(into: dict) -> None:
            queue = list(into.values()) if budget >= edit_cost else []
            while queue:
                cost, read, node = queue.pop()
                for c, below in node.items():
                    if c and reach(into, below, cost + edit_cost, read):
                        queue.append((cost + edit_cost, read, below))

        inserted(states)
        for ch in unicodedata.normalize("NFD", _stripped(text)):
            after: dict[int, tuple[float, str, dict]] = {}
            choices = options(ch, self.script)
            for cost, read, node in states.values():
                for look in choices if ch in choices else (*choices, ch):
                    at: dict | None = node
                    for c in look:
                        at = at.get(c) if at else None
                    reach(after, at, cost, read + look)
                if cost + edit_cost <= budget:
                    reach(after, node, cost + edit_cost, read + choices[0])
                    for c, below in node.items():
                        if c:
                            reach(after, below, cost + edit_cost, read + choices[0])
            inserted(after)
            states = after
            if not states:
                return None
        ends = [(cost, -node[""][0], node[""][1], read) for cost, read, node in states.values() if "" in node]
        if not ends:
            return None
        cost, _, spelling, read = min(ends)
        return cost, spelling, unicodedata.normalize("NFC", read)


def canonical(text: str, trie: SpellingTrie) -> str:
    """The form of one string by the trie of its beginning, else by the table."""
    unlike, alien = _letters(text, trie.script)
    near = trie.nearest(text, 0.0 if unlike or alien else 1.0)
    if near is not None and near[0] == 0:
        return near[1]
    return by_table(text, trie.script) if near is None else near[2]


#: A trie holds the spellings of one group that begin alike in so many characters of their skeletons; edits are paid behind these.
BEGINNING = 3


def _keys(scripts: dict[str | None, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for g, t, s in zip(*[b.column(c).to_pylist() for c in ("grp", "term", "suspect")], strict=True):
                look = skeleton(t, scripts.get(g, "LATIN")) if s else unicodedata.normalize("NFD", t).translate(_SAME_LOOK)
                keys.append(look[:BEGINNING])
            yield b.append_column("key", pa.array(keys, pa.string()))

    return run


def _match(scripts: dict[str | None, str]):
    """Rows are sorted by group and beginning, suspect strings before plain spellings. A trie is built only where there is
    a suspect string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, trie = None, [], SpellingTrie()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["grp", "term", "n", "canonical"])

        for b in batches:
            out = []
            for group, term, n, suspicious, key in zip(*[b.column(c).to_pylist() for c in ("grp", "term", "n", "suspect", "key")], strict=True):
                if at != (group, key):
                    out += [(*w, canonical(w[1], trie)) for w in waiting]
                    at, waiting, trie = (group, key), [], SpellingTrie(scripts.get(group, "LATIN"))
                if suspicious:
                    waiting.append((group, term, n))
                else:
                    if waiting:
                        trie.add(term, n)
                    out.append((group, term, n, term))
            if out:
                yield batch(out)
        if waiting:
            yield batch([(*w, canonical(w[1], trie)) for w in waiting])

    return run


#: Groups whose alphabet isn't Latin, at most; they are named in the plan.
MAX_GROUPS = 10_000


def alphabets(vocabulary: DataFrame, group: str = "comp") -> dict[str | None, str]:
    """The groups in whose strings, weighted by n, more letters are Cyrillic or Greek than Latin."""
    n = lambda script: F.sum(F.length(F.regexp_replace("term", rf"[^\p{{Is{script}}}]", "")) * F.col("n"))
    per = vocabulary.groupBy(F.col(group).alias("g")).agg(*[n(x).alias(x) for x in ("LATIN", "CYRILLIC", "GREEK")])
    other = per.where("greatest(CYRILLIC, GREEK) > LATIN").limit(MAX_GROUPS + 1).collect()
    if len(other) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of other alphabets")
    return {r.g: "CYRILLIC" if r.CYRILLIC >= r.GREEK else "GREEK" for r in other}


def canonical_forms(vocabulary: DataFrame, group: str = "comp", scripts: dict[str | None, str] | None = None) -> DataFrame:
    """group, term, n, canonical from distinct (group, term) with n: each term's one consistent form within its group.

    NULL terms are left out, a NULL group is a group of its own. A string of invisible characters only becomes
    the empty string; plain strings, words of another alphabet and empty strings keep their form.
    """
    scripts = alphabets(vocabulary, group) if scripts is None else scripts
    v = vocabulary.where("term IS NOT NULL").select(F.col(group).alias("grp"), "term", "n", suspect("term", group, scripts).alias("suspect"))
    keyed = v.mapInArrow(_keys(scripts), "grp string, term string, n bigint, suspect boolean, key string")
    met = keyed.repartition("grp", "key").sortWithinPartitions("grp", "key", F.desc("suspect"), "term")
    return met.mapInArrow(_match(scripts), "grp string, term string, n bigint, canonical string").withColumnRenamed("grp", group)


def suspect(column: str, group: str = "comp", scripts: dict[str | None, str] = {}):
    """Whether a string has anything but plain characters of its group's alphabet."""
    plain = F.col(column).rlike(PLAIN)
    for script, pattern in PLAIN_OF.items():
        own = [g for g, s in scripts.items() if s == script]
        if own:
            named = F.col(group).isin([g for g in own if g is not None])
            plain = F.when(F.coalesce(named, F.lit(None in own)), F.col(column).rlike(pattern)).otherwise(plain)
    return ~plain


def canonical_table(vocabulary: DataFrame, group: str = "comp", scripts: dict[str | None, str] | None = None) -> DataFrame:
    """Of `canonical_forms`, the strings whose form differs."""
    return canonical_forms(vocabulary, group, scripts).where(~F.col("canonical").eqNullSafe(F.col("term")))
