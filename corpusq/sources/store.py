"""Corpora on disk: a folder of parquet tables and corpus.json, on any file system Spark can write to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusq.errors import CorpusError, VersionMismatch
from corpusq.functions import files
from corpusq.model import NO_EDGES, NO_EMPTY, NO_META, NO_MWT, PLACE, Corpus

VERSION = 1
#: Side tables; those with a schema may be missing.
_TABLES = {"sentences": None, "documents": None, "components": None, "alignment_meta": NO_META, "alignment_edges": NO_EDGES, "mwt": NO_MWT, "empty_nodes": NO_EMPTY}


def save(corpus: Corpus, path: str, force: bool = False) -> None:
    """Write a corpus; an existing folder is an error unless `force`. Tokens are range-partitioned and sorted by position,
    so position and document filters skip files and row groups, and a document of any size is spread.

    All is written to a new folder, which takes the place of the old one at the end: a failure leaves the old corpus as it was.
    """
    spark = corpus.spark
    path = path.rstrip("/")
    if files.exists(spark, path) and not force:
        raise CorpusError(f"{path} exists; use force to replace it")
    new = f"{path}.{uuid.uuid4().hex[:8]}"
    tokens = corpus.tokens(*PLACE, *corpus.layers, "no_space_after")
    tokens.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{new}/tokens")
    for name in _TABLES:
        getattr(corpus, name).write.parquet(f"{new}/{name}")
    counted = {x: spark.read.parquet(f"{new}/{x}").count() for x in ("tokens", "documents")}
    meta = {"version": VERSION, "name": corpus.name, "layers": list(corpus.layers), "token_count": counted["tokens"], "document_count": counted["documents"], "tables": list(_TABLES)}
    files.write_text(spark, f"{new}/corpus.json", json.dumps(meta, indent=1))
    if files.exists(spark, path):
        old = f"{new}.old"
        files.move(spark, path, old)
        files.move(spark, new, path)
        files.delete(spark, old)
    else:
        files.move(spark, new, path)


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    """A stored corpus. Another version is an error, and so is a table that was written and is gone; a side table that the
    corpus was stored without is empty."""
    if not files.exists(spark, f"{path}/corpus.json"):
        raise CorpusError(f"no corpus in {path}")
    meta = json.loads(files.read_text(spark, f"{path}/corpus.json"))
    if meta.get("version") != VERSION:
        raise VersionMismatch(f"version {meta.get('version')}, expected {VERSION}")
    side = {}
    for name, schema in _TABLES.items():
        if files.exists(spark, f"{path}/{name}"):
            side[name] = spark.read.parquet(f"{path}/{name}")
        elif name in meta.get("tables", _TABLES) or schema is None:
            raise CorpusError(f"{path}: table {name} is missing")
        else:
            side[name] = spark.createDataFrame([], schema)
    tokens = spark.read.parquet(f"{path}/tokens")
    return Corpus(spark, meta["name"], lambda columns: tokens.select("pos", *[F.col(f"`{c}`") for c in columns]), tuple(meta["layers"]), path=path, **side)
