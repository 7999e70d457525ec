"""A corpus: lazy tables and their metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.errors import UnknownLayer
from corpusq.functions.storage import written, written_in_parts
from corpusq.operators.latest import latest_valid

#: Layers every corpus has, and those of them that queries can test.
CORE_LAYERS = ("word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps")
INDEXED_LAYERS = ("word", "lemma", "upos", "xpos", "feats", "deprel")
#: Neighbouring positions that deliveries are told apart in together.
BLOCK = 4096
#: What a token row knows about where it stands.
PLACE = ("doc_idx", "doc_in_comp", "sent_idx", "sent_in_doc", "tok_in_sent", "comp", "sent_end", "doc_end")
NO_MWT = "start_pos bigint, end_pos bigint, form string, no_space_after boolean"
NO_EMPTY = "sent_idx int, node_id string, form string, lemma string, upos string, xpos string, feats string, deps string, misc string"
NO_META = "align_name string, source_component string, target_component string, edges string, source_layer string, target_layer string, directed boolean"
NO_EDGES = "align_name string, src_doc int, src_sent int, tgt_doc int, tgt_sent int, edge_no bigint"


@dataclass
class Corpus:
    """`tokens_of` gives the token table with pos and the named columns only, so no query reads more than it needs."""

    spark: SparkSession
    name: str
    tokens_of: Callable[[tuple[str, ...]], DataFrame]
    layers: tuple[str, ...]
    sentences: DataFrame  # sent_idx, sent_in_doc, doc_idx, start_pos, end_pos, sent_id
    documents: DataFrame  # doc_idx, doc_in_comp, comp, doc_name, start_pos, end_pos
    components: DataFrame  # comp_id, comp, comp_path, lang
    alignment_meta: DataFrame
    alignment_edges: DataFrame
    mwt: DataFrame
    empty_nodes: DataFrame
    path: str = ""
    _cache: dict = field(default_factory=dict)

    def tokens(self, *columns: str) -> DataFrame:
        return self.tokens_of(tuple(dict.fromkeys(columns)))

    @property
    def indexed_layers(self) -> tuple[str, ...]:
        return tuple(x for x in self.layers if x in INDEXED_LAYERS or x.startswith("feats."))

    def layer_kind(self, layer: str) -> str:
        if layer not in self.layers:
            raise UnknownLayer(layer)
        return "int" if layer == "head" else "string"

    def need_indexed(self, layer: str) -> str:
        layer = {"pos": "upos"}.get(layer, layer)
        if layer not in self.indexed_layers:
            raise UnknownLayer(layer)
        return layer


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def feature(key: str) -> Column:
    """The value of the first key=value pair of that key in feats."""
    own = F.filter(F.split("feats", r"\|"), lambda x: x.startswith(f"{key}="))
    return F.substr(F.try_element_at(own, F.lit(1)), F.lit(len(key) + 2))


def feature_keys(tokens: DataFrame) -> tuple[str, ...]:
    """The keys of key=value pairs in feats, a few dozen names."""
    pairs = F.filter(F.split("feats", r"\|"), lambda x: x.contains("="))
    found = tokens.select("feats").distinct().select(F.explode(F.transform(pairs, lambda x: F.split(x, "=", 2)[0])).alias("k")).distinct()
    return tuple(sorted(r.k for r in found.collect()))


def kept(corpus: Corpus, parts: int = 2) -> Corpus:
    """The corpus with its valid tokens, sentences and documents written once, for many queries in this application. Tokens
    stay in the blocks of positions that deliveries are told apart in, so this adds no exchange; every `parts`th block is
    written at a time, which reads the deliveries so many times and takes that part of the disk for their exchange."""
    nr = F.pmod(F.floor(F.col("pos") / BLOCK), F.lit(parts))
    tokens = written_in_parts(corpus.tokens(*PLACE, *corpus.layers, "no_space_after"), "valid-tokens", [nr == k for k in range(parts)])
    rest = {x: written(getattr(corpus, x), x) for x in ("sentences", "documents")}
    return replace(corpus, tokens_of=lambda columns: tokens.select("pos", *[F.col(f"`{c}`") for c in columns]), **rest)


def from_deliveries(spark: SparkSession, directory: str, features: tuple[str, ...] | None = (), block: int = BLOCK) -> Corpus:
    """A corpus over tables with repeated deliveries (the latest is valid), read lazily and column by column. `features` are
    the keys in feats that get a layer of their own; None: all that any delivery has."""
    read = lambda name: spark.read.parquet(f"{directory}/{name}.parquet")
    if features is None:
        features = feature_keys(read("tokens"))
    raw, own = read("tokens"), {f"feats.{k}": feature(k) for k in features}

    def tokens_of(columns: tuple[str, ...]) -> DataFrame:
        """With feats among the columns, its keys are taken from valid rows only: the exchange holds feats once."""
        late = {c: x for c, x in own.items() if c in columns and "feats" in columns}
        early = {c: x for c, x in own.items() if c in columns and c not in late}
        rows = raw.withColumns(early).select("pos", *[F.col(f"`{c}`") for c in columns if c not in late], "ingested_at")
        return latest_valid(rows, "pos", block=block).withColumns(late).select("pos", *[F.col(f"`{c}`") for c in columns])

    return Corpus(
        spark, "corpus", tokens_of, (*CORE_LAYERS, *(f"feats.{k}" for k in features)),
        latest_valid(read("sentences").select("sent_idx", "sent_in_doc", "doc_idx", "start_pos", "end_pos", "sent_id", "ingested_at"), "sent_idx").drop("ingested_at"),
        latest_valid(read("corpus_docs").select("doc_idx", "doc_in_comp", "comp", "doc_name", "start_pos", "end_pos", "ingested_at"), "doc_idx").drop("ingested_at"),
        read("components"),
        read("alignment_meta").withColumns({"source_layer": F.coalesce("source_layer", F.lit("sentence")), "target_layer": F.coalesce("target_layer", F.lit("sentence")), "directed": F.coalesce("directed", F.lit(True))}),
        read("alignment_edges").withColumn("edge_no", F.lit(None).cast("bigint")), _empty(spark, NO_MWT), _empty(spark, NO_EMPTY), directory,
    )
