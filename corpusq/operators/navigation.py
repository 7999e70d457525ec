"""Documents, sentences, components and alignments: lookups in the dimension tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.errors import Ambiguous, BadRange, NotFound, OutsideSource
from corpusq.model import Corpus
from corpusq.plans.compiler import need_alignment, resolve_targets

SPAN_LAYERS = ("sentence", "document")


def need_component(corpus: Corpus, name: str):
    rows = corpus.components.where(F.col("comp") == name).limit(1).collect()
    if not rows:
        raise NotFound(f"component {name}")
    return rows[0]


def resolve_document(corpus: Corpus, name: str, strict: bool = True) -> DataFrame:
    """Documents of that exact name, in whichever components; else the only one whose name without extension it is. Not
    `strict`, as a relation: none of a name that no document has, and all documents of the one name with that stem."""
    exact = corpus.documents.where(F.col("doc_name") == name)
    n = exact.select("comp").limit(2).collect()
    if n:
        if len(n) > 1:
            warnings.warn(f"document {name} exists in several components", stacklevel=2)
        return exact
    stem = corpus.documents.where(F.regexp_replace("doc_name", r"(?<=.)\.[^.]*$", "") == name)
    names = stem.select("doc_name")
    found = (names if strict else names.distinct()).limit(2).collect()
    if strict and not found:
        raise NotFound(f"document {name}")
    if len(found) > 1:
        raise Ambiguous(f"document {name}: {', '.join(r.doc_name for r in found)}")
    return stem


def info(corpus: Corpus) -> dict:
    """Name, path, sizes, layers, components, alignments."""
    d = corpus.documents.agg(F.count(F.lit(1)).alias("n"), F.max("end_pos").alias("tokens")).first()
    return {
        "name": corpus.name, "path": corpus.path, "token_count": d.tokens or 0, "document_count": d.n, "layers": list(corpus.layers), "indexed_layers": list(corpus.indexed_layers), "span_layers": list(SPAN_LAYERS),
        "components": [r.comp for r in corpus.components.orderBy("comp_id").select("comp").collect()],
        "alignments": [r.align_name for r in corpus.alignment_meta.select("align_name").distinct().orderBy("align_name").collect()],
    }


def documents(corpus: Corpus, component: str | None = None) -> DataFrame:
    """doc_idx, comp, doc_name in document order of their numbers; an unknown component is an error."""
    d = corpus.documents
    if component is not None:
        need_component(corpus, component)
        d = d.where(F.col("comp") == component)
    return d.select("doc_idx", F.coalesce("comp", F.lit(corpus.name)).alias("comp"), "doc_name")


def components(corpus: Corpus) -> DataFrame:
    """comp, lang, first and last document; a corpus without components is one of its own name."""
    own = corpus.components
    ranges = corpus.documents.groupBy("comp").agg(F.min("doc_idx").alias("doc_start"), (F.max("doc_idx") + 1).alias("doc_end"))
    if own.limit(1).count():
        return own.join(ranges, "comp", "left").select("comp_id", "comp", "lang", "doc_start", "doc_end")
    return ranges.select(F.lit(0).alias("comp_id"), F.lit(corpus.name).alias("comp"), F.lit(None).cast("string").alias("lang"), "doc_start", "doc_end")


def _spans(corpus: Corpus, layer: str) -> DataFrame:
    if layer not in SPAN_LAYERS:
        raise NotFound(f"span layer {layer}")
    t = corpus.sentences if layer == "sentence" else corpus.documents
    return t.select(F.col("sent_idx" if layer == "sentence" else "doc_idx").alias("idx"), "start_pos", "end_pos")


def span_at(corpus: Corpus, layer: str, index: int) -> DataFrame:
    return _spans(corpus, layer).where(F.col("idx") == index)


def span_containing(corpus: Corpus, layer: str, pos: int) -> DataFrame:
    return _spans(corpus, layer).where((F.col("start_pos") <= pos) & (F.col("end_pos") > pos))


def span_count(corpus: Corpus, layer: str) -> int:
    return _spans(corpus, layer).count()


def document_at(corpus: Corpus, index: int) -> DataFrame:
    return corpus.documents.where(F.col("doc_idx") == index)


def document_for_position(corpus: Corpus, pos: int) -> DataFrame:
    return corpus.documents.where((F.col("start_pos") <= pos) & (F.col("end_pos") > pos))


def document_for_sentence(corpus: Corpus, sent_idx: int) -> DataFrame:
    at = corpus.sentences.where(F.col("sent_idx") == sent_idx).select("doc_idx")
    return corpus.documents.join(at, "doc_idx", "left_semi")


def document_indices(corpus: Corpus, name: str) -> list[int]:
    return [r.doc_idx for r in corpus.documents.where(F.col("doc_name") == name).orderBy("doc_idx").select("doc_idx").collect()]


def edge_sentences(corpus: Corpus, doc_idx: int) -> tuple[int, int] | None:
    """First and last sentence of a document."""
    r = corpus.sentences.where(F.col("doc_idx") == doc_idx).agg(F.min("sent_idx"), F.max("sent_idx")).first()
    return None if r[0] is None else (r[0], r[1])


def sentence(corpus: Corpus, doc_idx: int, sent_in_doc: int) -> DataFrame:
    return corpus.sentences.where((F.col("doc_idx") == doc_idx) & (F.col("sent_in_doc") == sent_in_doc))


def sentences(corpus: Corpus, doc_idx: int, start: int, end: int) -> DataFrame:
    """Sentences start..end of a document; the end is clamped."""
    if start > end:
        raise BadRange(f"{start} > {end}")
    return corpus.sentences.where((F.col("doc_idx") == doc_idx) & (F.col("sent_in_doc") >= start) & (F.col("sent_in_doc") < end))


def sentence_span(corpus: Corpus, component: str, doc_in_comp: int, sent_in_doc: int) -> DataFrame:
    d = corpus.documents.where((F.col("comp") == component) & (F.col("doc_in_comp") == doc_in_comp)).select("doc_idx")
    return corpus.sentences.where(F.col("sent_in_doc") == sent_in_doc).join(d, "doc_idx", "left_semi").select("sent_idx", "start_pos", "end_pos")


def sentence_id(corpus: Corpus, sent_idx: int) -> str | None:
    r = corpus.sentences.where(F.col("sent_idx") == sent_idx).select("sent_id").first()
    return r and r.sent_id


def component_for_document(corpus: Corpus, doc_idx: int) -> str | None:
    r = corpus.documents.where(F.col("doc_idx") == doc_idx).select("comp").first()
    return r and r.comp


def components_of_language(corpus: Corpus, language: str) -> list[str]:
    return [r.comp for r in corpus.components.where(F.col("lang") == language).orderBy("comp_id").collect()]


def alignments(corpus: Corpus) -> DataFrame:
    """Metadata with the number of edges."""
    n = corpus.alignment_edges.groupBy("align_name").agg(F.count(F.lit(1)).alias("edge_count"))
    return corpus.alignment_meta.select("align_name", "source_component", "target_component", "source_layer", "target_layer", "directed").join(n, "align_name", "left").fillna(0, ["edge_count"])


def alignment_edges(corpus: Corpus, name: str) -> DataFrame:
    need_alignment(corpus, name)
    return corpus.alignment_edges.where(F.col("align_name") == name).drop("edge_no")


def alignment_coverage(corpus: Corpus, name: str) -> DataFrame:
    """doc_idx, doc_name, aligned, total: source sentences with an edge, of all documents of the source component."""
    meta = need_alignment(corpus, name)
    units = corpus.alignment_edges.where(F.col("align_name") == name).select("src_doc", "src_sent").distinct().withColumn("hit", F.lit(1))
    docs = corpus.documents.where(F.col("comp") == meta["source_component"]).select("doc_idx", "doc_name", F.col("doc_in_comp").alias("src_doc"))
    sents = corpus.sentences.select("doc_idx", F.col("sent_in_doc").alias("src_sent"))
    return docs.join(sents, "doc_idx", "left").join(units, ["src_doc", "src_sent"], "left").groupBy("doc_idx", "doc_name").agg(F.count("hit").alias("aligned"), F.count("src_sent").alias("total"))


def project_hits(corpus: Corpus, hits: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Targets of hits, each once, and counters: unmapped hits (in no sentence of the source component), hits in
    sentences without an edge, distinct targets projected."""
    meta = need_alignment(corpus, name)
    src = corpus.documents.where(F.col("comp") == meta["source_component"]).select("doc_idx", F.col("doc_in_comp").alias("src_doc"))
    inside = F.col("end_pos") <= F.col("sent_end")
    units = corpus.sentences.select("sent_idx", F.col("sent_in_doc").alias("src_sent"))
    at = hits.withColumn("own", F.when(inside, F.col("sent_idx"))).join(units.withColumnRenamed("sent_idx", "own"), "own", "left").join(src, "doc_idx", "left")
    edges = corpus.alignment_edges.where(F.col("align_name") == name)
    linked = edges.select("src_doc", "src_sent").distinct().withColumn("edge", F.lit(1))
    located = F.col("src_doc").isNotNull() & F.col("src_sent").isNotNull()
    state = F.when(~located, "unmapped").when(F.col("edge").isNull(), "no_alignment")
    counted = at.join(linked, ["src_doc", "src_sent"], "left").select(state.alias("counter")).where("counter IS NOT NULL").groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    targets = resolve_targets(corpus, at.where(located).select("src_doc", "src_sent").distinct().join(edges, ["src_doc", "src_sent"]).select("tgt_doc", "tgt_sent").distinct(), meta)
    counted = counted.union(targets.agg(F.lit("projected"), F.count(F.lit(1))))
    names = corpus.spark.createDataFrame([("unmapped",), ("no_alignment",), ("projected",)], "counter string")
    return targets, names.join(counted, "counter", "left").fillna(0, ["n"])


def project_range(corpus: Corpus, name: str, doc_idx: int, start: int, end: int) -> DataFrame:
    """Target sentences of every source sentence of a document that overlaps [start, end), each once, in the order of
    source sentences and then of edges; nr counts them in that order. Edges that came without an order count by target."""
    meta = need_alignment(corpus, name)
    own = corpus.documents.where((F.col("doc_idx") == doc_idx) & (F.col("comp") == meta["source_component"])).select("doc_idx", F.col("doc_in_comp").alias("src_doc"))
    if not own.limit(1).count():
        raise OutsideSource(f"document {doc_idx} is not in {meta['source_component']}")
    sents = corpus.sentences.where((F.col("start_pos") < end) & (F.col("end_pos") > start)).select("doc_idx", F.col("sent_in_doc").alias("src_sent"))
    edges = corpus.alignment_edges.where(F.col("align_name") == name)
    place = F.struct("src_sent", "edge_no", "tgt_doc", "tgt_sent")
    found = sents.join(own, "doc_idx").drop("doc_idx").join(edges, ["src_doc", "src_sent"]).groupBy("tgt_doc", "tgt_sent").agg(F.min(place).alias("place"))
    targets = resolve_targets(corpus, found, meta)
    return targets.withColumn("nr", F.row_number().over(Window.orderBy("place")) - 1).drop("place").orderBy("nr")  # the targets of one range
