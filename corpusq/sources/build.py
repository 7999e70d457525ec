"""Parsed rows to corpus tables: positions, spans, side tables; manifests of components and alignments."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.errors import CorpusError, FormatError
from corpusq.functions import files
from corpusq.functions.ordering import running_offsets
from corpusq.functions.storage import written
from corpusq.model import CORE_LAYERS, NO_EDGES, NO_META, Corpus, feature
from corpusq.sources.readers import ConlluReader, CorpusReader, Parsed

RANGE_ID, EMPTY_ID = r"^\d+-\d+$", r"^\d+\.\d+$"


def _absent(c: str) -> F.Column:
    """Empty and underscore mean no value."""
    return F.nullif(F.nullif(F.col(c), F.lit("_")), F.lit(""))


def _space_off() -> F.Column:
    return F.coalesce(F.array_contains(F.split("misc", r"\|"), "SpaceAfter=No"), F.lit(False))


@dataclass
class Alignment:
    name: str
    source: str
    target: str
    edges: str = ""
    source_layer: str = "sentence"
    target_layer: str = "sentence"
    directed: bool = True


@dataclass
class Manifest:
    name: str
    components: dict[str, dict[str, str]]  # name -> path, language
    alignments: list[Alignment] = field(default_factory=list)
    decompose_feats: bool = False
    base: str = "."


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """[corpus] name, decompose_feats; [components.X] path, language; [alignments.N] source, target, edges, source_layer,
    target_layer, directed. Paths are relative to the manifest's folder."""
    try:
        data = tomllib.loads(files.read_text(spark, path))
        corpus = data["corpus"]
        comps = {k: {"path": v["path"], "language": v.get("language")} for k, v in data.get("components", {}).items()}
        aligned = [Alignment(k, v["source"], v["target"], v["edges"], v.get("source_layer", "sentence"), v.get("target_layer", "sentence"), v.get("directed", True)) for k, v in sorted(data.get("alignments", {}).items())]
        return Manifest(corpus["name"], comps, aligned, corpus.get("decompose_feats", False), files.parent(path))
    except (KeyError, TypeError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise FormatError(f"{path}: {e!r}") from e


def assemble(spark: SparkSession, name: str, parsed: list[tuple[str | None, Parsed]], components: list[tuple[str, str, str | None]] = (), decompose: bool = False) -> Corpus:
    """Tables from parsed rows by component, which come in the order of their names; documents in that of their files."""
    rows = reduce(DataFrame.unionByName, [p.rows.withColumn("comp", F.lit(c).cast("string")) for c, p in parsed])
    kind = F.when(F.col("id").rlike(RANGE_ID), "range").when(F.col("id").rlike(EMPTY_ID), "empty").otherwise("token")
    rows = written(rows.withColumn("kind", kind).withColumn("comp_key", F.coalesce("comp", F.lit(""))), "parsed")
    tok = rows.where("kind = 'token'")
    # sentences and documents without a token have no span
    sent_sizes = tok.groupBy("comp_key", "comp", "file", "sent_no").agg(F.count(F.lit(1)).alias("n"), F.max("sent_id").alias("sent_id"))
    sents = written(running_offsets(sent_sizes, ["comp_key", "file", "sent_no"], {"start_pos": "n", "sent_idx": None}), "sentences")
    doc_sizes = sents.groupBy("comp_key", "comp", "file").agg(F.min("start_pos").alias("start_pos"), F.sum("n").alias("size"), F.min("sent_idx").alias("first_sent"))
    numbered = running_offsets(doc_sizes, ["comp_key", "file"], {"doc_idx": None})
    firsts = numbered.groupBy("comp_key").agg(F.min("doc_idx").alias("first_doc"))
    docs = written(numbered.join(firsts, "comp_key").select("comp_key", "comp", "file", F.col("doc_idx").cast("int"), (F.col("doc_idx") - F.col("first_doc")).cast("int").alias("doc_in_comp"), F.element_at(F.split(F.expr("url_decode(replace(file, '+', '%2B'))"), "/"), -1).alias("doc_name"), "start_pos", (F.col("start_pos") + F.col("size")).alias("end_pos"), "first_sent"), "documents")
    placed = sents.join(docs.select("comp_key", "file", "doc_idx", "doc_in_comp", "doc_name", "first_sent", F.col("end_pos").alias("doc_end")), ["comp_key", "file"])
    placed = placed.select("comp_key", "comp", "file", "sent_no", F.col("sent_idx").cast("int"), (F.col("sent_idx") - F.col("first_sent")).cast("int").alias("sent_in_doc"), "doc_idx", "doc_in_comp", "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"), "doc_end", F.coalesce("sent_id", F.concat_ws(":", "doc_name", (F.col("sent_idx") - F.col("first_sent")).cast("string"))).alias("sent_id"))
    placed = written(placed, "placed")
    nr = F.row_number().over(Window.partitionBy("comp_key", "file", "sent_no").orderBy("line_no"))
    keys = ["comp_key", "file", "sent_no"]
    at = placed.select(*keys, "sent_idx", "sent_in_doc", "doc_idx", "doc_in_comp", "start_pos", F.col("end_pos").alias("sent_end"), "doc_end")
    text = [_absent(c).alias(c) for c in ("lemma", "upos", "xpos", "feats", "deprel", "deps")]
    tokens = tok.withColumn("tok_in_sent", nr).join(at, keys).select(
        (F.col("start_pos") + F.col("tok_in_sent") - 1).alias("pos"), "comp", "doc_idx", "doc_in_comp", "sent_idx", "sent_in_doc", "tok_in_sent", "sent_end", "doc_end",
        "word", *text, F.expr("try_cast(head AS INT)").alias("head"), _space_off().alias("no_space_after"),
    )
    extra: list[str] = []
    if decompose:
        pairs = F.filter(F.split("feats", r"\|"), lambda x: x.contains("="))
        keys_found = tokens.select(F.explode(F.transform(pairs, lambda x: F.split(x, "=", 2)[0])).alias("k")).distinct().orderBy("k")
        for r in keys_found.collect():  # names of features, a few dozen
            tokens = tokens.withColumn(f"feats.{r.k}", feature(r.k))
            extra.append(f"feats.{r.k}")
    bounds = F.split("id", "-")
    mwt = rows.where("kind = 'range'").join(at, keys).select((F.col("start_pos") + F.get(bounds, F.lit(0)).cast("long") - 1).alias("start_pos"), (F.col("start_pos") + F.get(bounds, F.lit(1)).cast("long")).alias("end_pos"), F.col("word").alias("form"), _space_off().alias("no_space_after"))
    empty = rows.where("kind = 'empty'").join(at, keys).select("sent_idx", F.col("id").alias("node_id"), F.col("word").alias("form"), *[_absent(c).alias(c) for c in ("lemma", "upos", "xpos", "feats", "deps", "misc")])
    comp_rows = [(i, c, p, lang) for i, (c, p, lang) in enumerate(components)]
    sentences = placed.select("sent_idx", "sent_in_doc", "doc_idx", "start_pos", "end_pos", "sent_id")

    def tokens_of(columns: tuple[str, ...]) -> DataFrame:
        return tokens.select("pos", *[F.col(f"`{c}`") for c in columns])

    return Corpus(
        spark, name, tokens_of, (*CORE_LAYERS, *extra), sentences, docs.select("doc_idx", "doc_in_comp", "comp", "doc_name", "start_pos", "end_pos"),
        spark.createDataFrame(comp_rows, "comp_id int, comp string, comp_path string, lang string"),
        spark.createDataFrame([], NO_META), spark.createDataFrame([], NO_EDGES), mwt, empty,
    )


def build_directory(spark: SparkSession, path: str, name: str | None = None, strict: bool = False, decompose: bool = False, reader: CorpusReader | None = None) -> Corpus:
    """All files below a folder, without components."""
    parsed = (reader or ConlluReader()).read(spark, path, strict)
    return assemble(spark, name or path.rstrip("/").rpartition("/")[2], [(None, parsed)], decompose=decompose)


def build_manifest(spark: SparkSession, path: str, strict: bool = False, reader: CorpusReader | None = None) -> Corpus:
    m = read_manifest(spark, path)
    for a in m.alignments:
        for side in (a.source, a.target):
            if side not in m.components:
                raise CorpusError(f"alignment {a.name}: unknown component {side}")
    names = sorted(m.components)
    parsed = [(c, (reader or ConlluReader()).read(spark, files.resolve(m.base, m.components[c]["path"]), strict)) for c in names]
    corpus = assemble(spark, m.name, parsed, [(c, m.components[c]["path"], m.components[c]["language"]) for c in names], m.decompose_feats)
    if m.alignments:
        corpus.alignment_meta = spark.createDataFrame([(a.name, a.source, a.target, a.edges, a.source_layer, a.target_layer, a.directed) for a in m.alignments], NO_META)
        corpus.alignment_edges = reduce(DataFrame.unionByName, [read_edges(corpus, a, files.resolve(m.base, a.edges), strict) for a in m.alignments])
    return corpus


def read_edges(corpus: Corpus, a: Alignment, path: str, strict: bool = False) -> DataFrame:
    """Edges of one file or of all *.tsv in a folder: source document, its sentence, target document, its sentence.

    Blank lines and comments don't count. Short lines and unknown documents are left out or, with `strict`, an error; a sentence
    number that is none is always one. Repeated edges are kept; edge_no is their order, over all files.
    """
    spark = corpus.spark
    paths = files.children(spark, path, "*.tsv") if files.is_dir(spark, path) else [path]
    if not paths:
        return spark.createDataFrame([], NO_EDGES)
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = running_offsets(read.where("trim(value) <> '' AND NOT startswith(trim(value), '#')"), ["file", "block", "row"], {"edge_no": None})
    f = lines.select("value", "edge_no", F.split("value", "\t").alias("f"))
    cells = [F.trim(F.get("f", F.lit(i))) for i in range(4)]
    rows = f.where(F.size("f") >= 4).select("value", "edge_no", cells[0].alias("src_name"), F.expr("try_cast(trim(f[1]) AS INT)").alias("src_sent"), cells[2].alias("tgt_name"), F.expr("try_cast(trim(f[3]) AS INT)").alias("tgt_sent"))
    docs = corpus.documents.select("comp", "doc_name", "doc_in_comp")
    src = docs.where(F.col("comp") == a.source).select(F.col("doc_name").alias("src_name"), F.col("doc_in_comp").alias("src_doc"))
    tgt = docs.where(F.col("comp") == a.target).select(F.col("doc_name").alias("tgt_name"), F.col("doc_in_comp").alias("tgt_doc"))
    joined = rows.join(src, "src_name", "left").join(tgt, "tgt_name", "left")
    bad = rows.where("src_sent IS NULL OR tgt_sent IS NULL OR src_sent < 0 OR tgt_sent < 0").limit(1).collect()
    if bad:
        raise FormatError(f"{a.name}: not a sentence number: {bad[0].value}")
    if strict:
        short = f.where(F.size("f") < 4).select("value").limit(1).collect() or joined.where("src_doc IS NULL OR tgt_doc IS NULL").select("value").limit(1).collect()
        if short:
            raise FormatError(f"{a.name}: {short[0].value}")
    return joined.where("src_doc IS NOT NULL AND tgt_doc IS NOT NULL").select(F.lit(a.name).alias("align_name"), "src_doc", "src_sent", "tgt_doc", "tgt_sent", "edge_no")


class CorpusBuilder:
    """Documents added one by one; `build` makes the corpus of all of them."""

    def __init__(self, spark: SparkSession, name: str, decompose: bool = False):
        self.spark, self.name, self.decompose, self.texts = spark, name, decompose, []

    def add_document(self, name: str, text: str) -> CorpusBuilder:
        self.texts.append((f"{len(self.texts):09d}/{name}", text))
        return self

    def add_sentences(self, text: str) -> CorpusBuilder:
        return self.add_document("unknown", text)

    def build(self, strict: bool = False) -> Corpus:
        files = self.spark.createDataFrame(self.texts, "file string, value string")
        return assemble(self.spark, self.name, [(None, ConlluReader().parse(files, strict))], decompose=self.decompose)
