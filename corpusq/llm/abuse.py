"""Abusive, hateful and sexual content: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A document is as bad as its worst passage (sentence). Judgements exist for whole documents, so training alternates: all
sentences of a harmless document are harmless; of a bad one, the sentence the model so far finds worst is bad, the
rest are left out. Some judgements are wrong, and a model learns by heart what it is told: whether a bad judgement is doubted is said by
models that haven't seen it. Words are brought to one form first (look-alikes, digits for letters, repeated or spaced-out letters),
then hashed; n-grams are sums of rotated word hashes, made for a whole batch of sentences by array arithmetic. L1
leaves few weights: at most 2**BITS, whatever the data, so they go to every task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.lookalikes import by_table, options
from corpusq.llm.samples import bounded_sample

BITS = 20
MASK = np.uint64((1 << BITS) - 1)
#: The classifier is fitted on at most this many judged documents, chosen by hash of the id.
MAX_LABELLED = 20_000
#: One bad sentence weighs as much as so many harmless ones, which are far more.
BAD_WEIGHT = 3.0
#: Bad judgements are left out whose worst passage scores less than that of this part of the documents judged harmless, each
#: scored by a fit without the part (of FOLDS) that its text is in. The second round's fits are without what the first left out.
LIKE_HARMLESS, FOLDS, ROUNDS, HELD_EPOCHS = 0.9, 4, 2, 3
#: The weights are the mean of so many states of the last epoch: single updates move short sentences a lot.
STATES = 8
#: Texts of one Arrow batch are taken in slices of about this many characters.
SLICE_CHARS = 2_000_000
_TOKEN = re.compile(r"\n|[.!?]+(?=[\s\"»”)]|$)|[^\s.!?,;:\"«»“”()\[\]…¿¡]+(?:[.!](?=[\w@$])[^\s.!?,;:\"«»“”()\[\]…¿¡]+)*")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_]\w){3,}(?!\w)")
#: Digits and signs written for letters.
_LEET = str.maketrans("013457@$!€", "oieastasie")
_RUN = re.compile(r"(.)\1+")
END = np.uint64(0)


@lru_cache(500_000)
def word_form(word: str) -> str:
    """Lower case, look-alikes and accents resolved, letters for digits within words, no repeated letters, no marks."""
    w = word.lower() if word.isascii() else by_table(word).lower()
    if any(c.isalpha() for c in w):
        if not w.isalpha():
            w = re.sub(r"[*#_\-.]+", "", w.translate(_LEET))
        w = _RUN.sub(r"\1", w)
    elif w[:1].isdigit():
        w = "0"
    return w


@lru_cache(500_000)
def word_hash(word: str) -> tuple[int, int]:
    """At the beginning of a sentence and within; 0 ends a sentence, words have other values. Within, all capitalized words
    are one: names tell nothing, that there is one does."""
    if word == "\n" or word[0] in ".!?":
        return 0, 0
    h = _number(word_form(word))
    return h, NAME if word[0].isupper() and not word.isupper() else h


def _number(form: str) -> int:
    return (zlib.crc32(form.encode()) * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF or 1


NAME = _number("\x00name")


def _word_hashes(text: str) -> list[int]:
    out, within = [], 0
    for w in _words(text):
        h = word_hash(w)[within]
        out.append(h)
        within = h != 0
    return out


def _words(text: str) -> list[str]:
    if not text.isascii():
        text = "".join([c for c in text if options(c) != ("",)]) if any(options(c) == ("",) for c in set(text)) else text
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), text)
    return _TOKEN.findall(text)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, the sentence of each word and the text of each sentence; sentences have at least a word."""
    flat: list[int] = []
    sizes = []
    for t in texts:
        words = _word_hashes(t) if t else []
        words.append(0)
        flat += words
        sizes.append(len(words))
    h = np.array(flat, np.uint64)
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.cumsum(h == END)
    keep = h != END
    h, of, at = h[keep], of[keep], at[keep]
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    return h, np.cumsum(first) - 1, of[first]


def features(h: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, sentence) of unigrams, bigrams, trigrams and skip-grams over one and two words."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mix = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40) & MASK
    rot = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    out, where = [mix(h)], [sentence]
    for gap, salt in ((1, 7), (2, 19), (3, 31)):
        if len(h) > gap:
            same = sentence[gap:] == sentence[:-gap]
            out.append(mix(h[:-gap][same] + rot(h[gap:][same], salt)))
            where.append(sentence[gap:][same])
    if len(h) > 2:
        same = sentence[2:] == sentence[:-2]
        out.append(mix(h[:-2][same] + rot(h[1:-1][same], 11) + rot(h[2:][same], 23)))
        where.append(sentence[2:][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


class Ftrl:
    """FTRL-proximal with a learning rate of its own for each coordinate; updates take small batches of sentences."""

    def __init__(self, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.1, l2: float = 0.3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, feature: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        keys, inv = np.unique(feature, return_inverse=True)
        w = self.weights(keys)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
        p = _sigmoid(np.bincount(row, w[inv], len(y)) * scale * GAIN + BIAS)
        g = np.bincount(inv, ((p - y) * weight * scale * GAIN)[row], len(keys))
        more = np.sqrt(self.n[keys] + g * g) - np.sqrt(self.n[keys])
        self.z[keys] += g - more / self.alpha * w
        self.n[keys] += g * g


GAIN, BIAS = 4.0, -2.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_scores(w: np.ndarray, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    count = np.maximum(np.bincount(sentence, minlength=n), 1)
    return _sigmoid(np.bincount(sentence, w[feature], n) / np.sqrt(count) * GAIN + BIAS)


class Passages:
    """The sentences of judged documents with their features, ordered by sentence."""

    def __init__(self, texts: list[str], labels: list[int]):
        h, sent, self.doc = hashed(texts)
        feature, row = features(h, sent)
        order = np.argsort(row, kind="stable")
        self.feature, self.row = feature[order], row[order]
        self.n, self.y = len(self.doc), np.asarray(labels, float)
        self.start = np.searchsorted(self.row, np.arange(self.n + 1))
        self.met = np.flatnonzero(np.bincount(self.feature, minlength=1 << BITS))

    def weights(self, model: Ftrl) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.met] = model.weights(self.met)
        return out

    def learn(self, judged: np.ndarray, epochs: int, batch: int, seed: int) -> np.ndarray:
        """Weights by hashed feature, learnt from the documents where `judged`."""
        model, rng = Ftrl(), np.random.default_rng(seed)
        known = judged[self.doc]
        if not known.any():
            return np.zeros(1 << BITS)
        y = self.y[self.doc]
        weight = np.where(y > 0, 1 / np.bincount(self.doc)[self.doc], 1.0)
        total, states = np.zeros(1 << BITS), 0
        for epoch in range(epochs):
            if epoch:
                rank = np.lexsort((-sentence_scores(self.weights(model), self.feature, self.row, self.n), self.doc))
                top = np.zeros(self.n, bool)
                top[rank[np.r_[True, self.doc[rank][1:] != self.doc[rank][:-1]]]] = True
                weight = np.where(y > 0, top * BAD_WEIGHT, 1.0)
            use = np.flatnonzero((weight > 0) & known)
            parts = np.array_split(rng.permutation(use), max(1, len(use) // batch))
            for k, part in enumerate(parts):
                size = self.start[part + 1] - self.start[part]
                at = np.repeat(self.start[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                model.update(self.feature[at], np.repeat(np.arange(len(part)), size), y[part], weight[part])
                if epoch == epochs - 1 and (len(parts) - 1 - k) % max(1, len(parts) // STATES) == 0:
                    total[self.met] += model.weights(self.met)
                    states += 1
        return total / states

    def worst(self, w: np.ndarray) -> np.ndarray:
        """The worst sentence's score of each document."""
        out = np.zeros(len(self.y))
        np.maximum.at(out, self.doc, sentence_scores(w, self.feature, self.row, self.n))
        return out

    def doubted(self, fold: np.ndarray, batch: int, seed: int) -> np.ndarray:
        """Bad judgements that look harmless to models which haven't seen them; none if these would be more than half: then
        the judgements are too few to tell."""
        out = np.zeros(len(self.y), bool)
        for _ in range(ROUNDS):
            score, asked = np.zeros(len(self.y)), np.zeros(len(self.y), bool)
            for k in range(FOLDS):
                held, others = fold == k, (fold != k) & ~out
                if self.y[held].any() and self.y[others].any():
                    score[held], asked[held] = self.worst(self.learn(others, HELD_EPOCHS, batch, seed))[held], True
            harmless = score[asked & (self.y == 0)]
            out = asked & (self.y > 0) & (score < (np.quantile(harmless, LIKE_HARMLESS) if len(harmless) else 0))
            if 2 * out.sum() > self.y.sum():
                return np.zeros(len(self.y), bool)
        return out


def fit(texts: list[str], labels: list[int], epochs: int = 5, batch: int = 256, seed: int = 3) -> np.ndarray:
    """Weights by hashed feature. Copies of a text are in one fold."""
    passages = Passages(texts, labels)
    fold = np.array([zlib.crc32((t or "").encode()) % FOLDS for t in texts])
    return passages.learn(~passages.doubted(fold, batch, seed), epochs, batch, seed)


def document_scores(w: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The worst sentence's score; 0 without any word."""
    out = np.zeros(len(texts))
    h, sent, doc = hashed(texts)
    if len(doc):
        np.maximum.at(out, doc, sentence_scores(w, *features(h, sent), len(doc)))
    return out


def majority(labels: DataFrame) -> DataFrame:
    """doc_id, y: what most raters of a document say; documents with as many on either side are left out."""
    return labels.where("doc_id IS NOT NULL AND abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("y")).where("y <> 0.5").select("doc_id", F.expr("CAST(y > 0.5 AS INT)").alias("y"))


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Weights fitted on the judged documents, `max_labelled` of them at most, chosen by hash of the id, and no more than
    samples.MAX_CHARS characters."""
    chosen = majority(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    judged = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = bounded_sample(judged, "doc_id", "text", max_labelled).select("text", "y").toArrow()
    return fit(rows["text"].to_pylist(), rows["y"].to_pylist())


def score_documents(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """`documents` with `score` in [0, 1]: how sure the model is that its worst passage is bad. NULL and empty texts have 0.

    Only the weights are sent to tasks, as (index, value) of those that are not 0. One pass, no shuffle.
    """
    if "score" in documents.columns:
        raise ValueError("column name in use: score")
    at = np.flatnonzero(weights)
    sent = documents.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[sent.value[0]] = sent.value[1]
        for b in batches:
            texts, scores, i = b.column("text").to_pylist(), [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < SLICE_CHARS):
                    size += len(texts[j] or "")
                    j += 1
                scores.append(document_scores(w, texts[i:j]))
                i = j
            yield b.append_column("score", pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64()))

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())]))
