"""python -m corpusq: build, query, count, info, docs, components, layers, vocab over stored corpora."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corpusq.errors import CorpusError
from corpusq.operators import counts, navigation, text
from corpusq.operators.navigation import resolve_document
from corpusq.plans import cql
from corpusq.plans.compiler import run
from corpusq.sources import store
from corpusq.sources.build import build_directory, build_manifest


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusq")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="a folder of files or a manifest into a stored corpus")
    b.add_argument("source")
    b.add_argument("output")
    b.add_argument("--name")
    b.add_argument("--strict", action="store_true")
    b.add_argument("--decompose-feats", action="store_true")
    b.add_argument("--force", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("corpus")
    q.add_argument("query")
    q.add_argument("--limit", type=int, default=20)
    q.add_argument("--count-only", action="store_true")
    q.add_argument("--component")
    q.add_argument("--document")
    c = sub.add_parser("count")
    c.add_argument("corpus")
    c.add_argument("query")
    c.add_argument("--by", choices=("document", "component"))
    c.add_argument("--component")
    c.add_argument("--document")
    v = sub.add_parser("vocab")
    v.add_argument("corpus")
    v.add_argument("layer")
    v.add_argument("--component")
    v.add_argument("--document")
    for name in ("info", "docs", "components", "layers"):
        x = sub.add_parser(name)
        x.add_argument("corpus")
        if name == "docs":
            x.add_argument("--component")
    return p


def _scoped(corpus, query: str, component: str | None, document: str | None):
    node = cql.parse(query)
    if component:
        node = cql.in_component(node, (component,))
    hits = run(corpus, node)
    return hits.join(resolve_document(corpus, document).select("doc_idx"), "doc_idx", "left_semi").where("end_pos <= doc_end") if document else hits


def lines(spark: SparkSession, a: argparse.Namespace):
    """What a command prints, line by line; long lists are streamed from the cluster."""
    if a.command == "build":
        built = build_manifest(spark, a.source, a.strict) if a.source.endswith(".toml") else build_directory(spark, a.source, a.name, a.strict, a.decompose_feats)
        store.save(built, a.output, a.force)
        return
    corpus = store.open_corpus(spark, a.corpus)
    tab = lambda df: ("\t".join("" if x is None else str(x) for x in r) for r in df.toLocalIterator())
    if a.command == "query":
        hits = _scoped(corpus, a.query, a.component, a.document)
        if a.count_only:
            yield str(hits.count())
        else:
            shown = text.kwic(corpus, hits.orderBy("start_pos", "end_pos").limit(a.limit))
            yield from (f"{r.doc_name}\t{r.start_pos}\t{r.left} >>> {r.match} <<< {r.right}" for r in shown.orderBy("start_pos", "end_pos").toLocalIterator())
    elif a.command == "count" and a.by == "document":
        yield from tab(counts.count_by_document(corpus, a.query, a.component, a.document).orderBy("doc_idx").select("comp", "doc_name", "n"))
    elif a.command == "count" and a.by == "component":
        yield from tab(counts.count_by_component(corpus, a.query).orderBy("comp"))
    elif a.command == "count":
        yield str(_scoped(corpus, a.query, a.component, a.document).count())
    elif a.command == "vocab":
        yield from tab(counts.vocabulary(corpus, a.layer, a.component, a.document))
    elif a.command == "docs":
        yield from tab(navigation.documents(corpus, a.component).orderBy("doc_idx").select("comp", "doc_name"))
    elif a.command == "components":
        yield from tab(navigation.components(corpus).orderBy("comp_id").select("comp", "lang"))
    elif a.command == "layers":
        yield from corpus.layers
    else:
        for k, v in navigation.info(corpus).items():
            yield f"{k}\t{', '.join(v) if isinstance(v, list) else v}"


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName("corpusq").getOrCreate()
    try:
        for line in lines(spark, a):
            print(line)
    except CorpusError as e:
        print(f"error {e.code}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
