"""Counts over hits, vocabularies and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.errors import NotFound
from corpusq.model import Corpus
from corpusq.operators.navigation import need_component, resolve_document
from corpusq.plans import cql
from corpusq.plans.compiler import run


def count(corpus: Corpus, query: str) -> int:
    """Number of hits; captures are not computed for it."""
    return run(corpus, _plain(cql.parse(query))).count()


def count_in_component(corpus: Corpus, query: str, component: str) -> int:
    return run(corpus, _plain(cql.in_component(cql.parse(query), (component,)))).count()


def _plain(node: cql.Node) -> cql.Node:
    """Without labels, where no condition needs them."""
    if isinstance(node, cql.Conditions):
        return node
    if isinstance(node, cql.Label):
        return cql.Repeat(_plain(node.inner), 1, 1)
    if isinstance(node, cql.Sequence):
        return cql.Sequence(tuple(p.inner if isinstance(p, cql.Label) else cql.Repeat(p.inner.inner, p.least, p.most) if isinstance(p, cql.Repeat) and isinstance(p.inner, cql.Label) else p for p in node.parts))
    if isinstance(node, (cql.WithinSpan, cql.WithinComponent, cql.WithinDocument, cql.Project)):
        rest = {k: v for k, v in vars(node).items() if k != "inner"}
        return type(node)(inner=_plain(node.inner), **rest)
    return node


def count_by_document(corpus: Corpus, query: str, component: str | None = None, document: str | None = None, strict: bool = True) -> DataFrame:
    """comp, doc_name, n of every document, those without hits too; a corpus without components has its own name there.
    An unknown document is an error if `strict`, else it has no row."""
    node = cql.parse(query)
    docs = corpus.documents
    if document is not None:
        docs = docs.join(resolve_document(corpus, document, strict).select("doc_idx"), "doc_idx", "left_semi")
    if component is not None:
        docs = docs.where(F.col("comp") == component)
    n = run(corpus, _plain(node)).groupBy("doc_idx").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(n, "doc_idx", "left").select("doc_idx", F.coalesce("comp", F.lit(corpus.name)).alias("comp"), "doc_name", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_component(corpus: Corpus, query: str) -> DataFrame:
    """comp, n of every component; a hit counts if it ends within its document."""
    hits = run(corpus, _plain(cql.parse(query))).where("end_pos <= doc_end")
    n = hits.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    return corpus.components.select("comp").join(n, "comp", "left").select("comp", F.coalesce("n", F.lit(0)).alias("n"))


def vocabulary(corpus: Corpus, layer: str, component: str | None = None, document: str | None = None, strict: bool = True) -> DataFrame:
    """Distinct values of a layer in byte order; an unknown layer, component or document is an error. An unknown document has
    no values instead, if not `strict`."""
    layer = corpus.need_indexed(layer)
    t = corpus.tokens(layer, "comp", "doc_idx")
    if component is not None:
        need_component(corpus, component)
        t = t.where(F.col("comp") == component)
    if document is not None:
        t = t.join(resolve_document(corpus, document, strict).select("doc_idx"), "doc_idx", "left_semi")
    return t.where(F.col(f"`{layer}`").isNotNull()).select(F.col(f"`{layer}`").alias("value")).distinct().orderBy("value")


def value_counts(corpus: Corpus, layer: str) -> DataFrame:
    layer = corpus.need_indexed(layer)
    return corpus.tokens(layer).where(F.col(f"`{layer}`").isNotNull()).groupBy(F.col(f"`{layer}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def value_count(corpus: Corpus, layer: str, value: str) -> int:
    """Positions holding a value, -1 if none does."""
    if layer not in corpus.indexed_layers:
        return -1
    return corpus.tokens(layer).where(F.col(f"`{layer}`") == value).count() or -1


def distinct_count(corpus: Corpus, layer: str) -> int:
    if layer not in corpus.indexed_layers:
        return 0
    return corpus.tokens(layer).select(F.count_distinct(F.col(f"`{layer}`"))).first()[0]


def distinct_counts(corpus: Corpus) -> DataFrame:
    """layer, n for every layer, one pass; layers that queries can't test have 0."""
    layers = [x for x in corpus.layers if x in corpus.indexed_layers]
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(f"`{x}`").alias("value")) for x in layers]))
    seen = corpus.tokens(*layers).select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    names = corpus.spark.createDataFrame([(x,) for x in corpus.layers], "layer string")
    return names.join(seen.groupBy("layer").agg(F.count(F.lit(1)).alias("n")), "layer", "left").fillna(0, ["n"])


def component_tokens(corpus: Corpus) -> DataFrame:
    """comp, n: positions from a component's first document to its last."""
    n = corpus.documents.groupBy("comp").agg((F.max("end_pos") - F.min("start_pos")).alias("n"))
    return corpus.components.select("comp").join(n, "comp", "left").select("comp", F.coalesce("n", F.lit(0)).alias("n"))


def spans_starting_in(corpus: Corpus, layer: str, start: int, end: int) -> int:
    """Spans of a layer whose start lies in [start, end); -1 for an unknown layer."""
    table = {"sentence": corpus.sentences, "document": corpus.documents}.get(layer)
    return -1 if table is None else table.where((F.col("start_pos") >= start) & (F.col("start_pos") < end)).count()


def sentence_counts(corpus: Corpus) -> DataFrame:
    """doc_idx, comp, doc_name, n of every document."""
    n = corpus.sentences.groupBy("doc_idx").agg(F.count(F.lit(1)).alias("n"))
    return corpus.documents.join(n, "doc_idx", "left").select("doc_idx", "comp", "doc_name", F.coalesce("n", F.lit(0)).alias("n"))


def token_count(corpus: Corpus) -> int:
    n = corpus.documents.agg(F.max("end_pos")).first()[0]
    if n is None:
        raise NotFound("no documents")
    return n
