"""Query trees to lazy DataFrames of hits.

A hit row has start_pos, end_pos, the place of its first token (doc_idx, sent_idx, comp, sent_end, doc_end) and for each
label that is kept cap_<label>_start and cap_<label>_end. Token tests become one filter; a sequence is a frontier of partial
matches joined with the positions of each further step; as long as all widths are fixed the join key is the start, so the
joins of a sequence share one partitioning. Repetition works on runs of neighbouring positions (a window within documents, over
matching positions only); gaps of any token need no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.errors import ExecutionError, UnknownAlignment
from corpusq.functions import spans
from corpusq.functions.regex import checked
from corpusq.model import Corpus
from corpusq.plans import cql

#: Fixed value: the widest repetition.
MAX_WIDTH = 100
#: Positions of a bucket; more than the widest repetition.
BUCKET = 128
PLACE = ("doc_idx", "sent_idx", "comp", "sent_end", "doc_end")


@dataclass(frozen=True)
class Options:
    """epsilon "runs": a left-out first step starts only where runs of the second begin; "standard": anywhere."""

    epsilon: str = "runs"


@dataclass(frozen=True)
class Step:
    node: cql.Node
    least: int = 1
    most: int | None = 1
    label: str | None = None

    @property
    def single(self) -> bool:
        return (self.least, self.most) == (1, 1)

    @property
    def widest(self) -> int:
        return MAX_WIDTH if self.most is None else min(self.most, MAX_WIDTH)

    @property
    def any_token(self) -> bool:
        return self.node == cql.Token()

    @property
    def negative(self) -> bool:
        return isinstance(self.node, cql.Token) and bool(self.node.tests) and not any(t.equal for t in self.node.tests)


def _step(node: cql.Node) -> Step:
    least, most = 1, 1
    if isinstance(node, cql.Repeat):
        least, most, node = node.least, node.most, node.inner
    return Step(node.inner, least, most, node.name) if isinstance(node, cql.Label) else Step(node, least, most)


def _layers(node: cql.Node) -> set[str]:
    own = {t.layer for t in node.tests} if isinstance(node, cql.Token) else set()
    return own.union(*[_layers(c) for c in node.children()])


def cap(label: str, edge: str) -> str:
    return f"cap_{label}_{edge}"


def captures(hits: DataFrame) -> list[str]:
    """Labels kept in the hits, in order."""
    return [c[4:-6] for c in hits.columns if c.startswith("cap_") and c.endswith("_start")]


class Compiler:
    def __init__(self, corpus: Corpus, node: cql.Node, options: Options = Options()):
        self.corpus, self.options = corpus, options
        layers = sorted(_layers(node) & set(corpus.indexed_layers))
        # one column set for all steps of a query, so that they share one scan and exchange
        self.base = corpus.tokens(*PLACE, *[x for x in layers if x not in PLACE])
        self.runs_of: dict[tuple, DataFrame] = {}

    def test(self, t: cql.Test) -> Column:
        if t.layer not in self.corpus.indexed_layers:
            match = F.lit(False)
        elif t.regex:
            match = F.coalesce(F.col(f"`{t.layer}`").rlike(checked(self.corpus.spark, t.value)), F.lit(False))
        else:
            match = F.col(f"`{t.layer}`").eqNullSafe(t.value)
        return match if t.equal else ~match

    def predicate(self, node: cql.Node) -> Column | None:
        """The node as a condition on one token, if its hits are those single tokens or only their starts count."""
        if isinstance(node, cql.Token):
            return reduce(Column.__and__, [self.test(t) for t in node.tests], F.lit(True))
        if isinstance(node, cql.Alternatives):
            parts = [self.predicate(o.inner if isinstance(o, cql.Label) else o) for o in node.options]
            return None if any(p is None for p in parts) else reduce(Column.__or__, parts)
        return None

    def scoped(self, scope: Column | None) -> DataFrame:
        return self.base if scope is None else self.base.where(scope)

    def positions(self, node: cql.Node, scope: Column | None = None, lenient: bool = False) -> DataFrame:
        """pos and place of the tokens at which hits of the node start. `scope` limits the tokens read; not within groups.
        `lenient`: a faulty expression anywhere in the node makes it match nothing."""
        try:
            return self._positions(node, scope)
        except ExecutionError:
            if lenient:
                return self.base.limit(0).select("pos", *PLACE)
            raise

    def _positions(self, node: cql.Node, scope: Column | None) -> DataFrame:
        p = self.predicate(node)
        if p is not None:
            t = self.scoped(scope)
            return (t if node == cql.Token() else t.where(p)).select("pos", *PLACE)
        if isinstance(node, cql.Alternatives):
            return reduce(DataFrame.union, [self._positions(o, None) for o in node.options]).distinct()
        return self.hits(node).select(F.col("start_pos").alias("pos"), *PLACE).distinct()

    def hits(self, node: cql.Node, scope: Column | None = None) -> DataFrame:
        if isinstance(node, (cql.Token, cql.Alternatives)):
            return self.positions(node, scope).select(F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), *PLACE)
        if isinstance(node, cql.Sequence):
            return self.sequence([_step(p) for p in node.parts], scope)
        if isinstance(node, (cql.Repeat, cql.Label)):
            return self.sequence([_step(node)], scope)
        if isinstance(node, cql.WithinSpan):
            end = {"sentence": "sent_end", "document": "doc_end"}.get(node.layer)
            inner = self.hits(node.inner, scope)
            return inner if end is None else inner.where(F.col("end_pos") <= F.col(end))
        if isinstance(node, cql.WithinComponent):
            own = F.col("comp").isin(list(node.names))
            return self.hits(node.inner, own if scope is None else scope & own).where(own & (F.col("end_pos") <= F.col("doc_end")))
        if isinstance(node, cql.WithinDocument):
            docs = self.corpus.documents.where(F.col("doc_name").isin(list(node.names))).select("doc_idx")
            return self.hits(node.inner, scope).where(F.col("end_pos") <= F.col("doc_end")).join(docs, "doc_idx", "left_semi")
        if isinstance(node, cql.Project):
            return self.project(self.hits(node.inner), node.alignment)
        if isinstance(node, cql.Conditions):
            return self.conditions(self.hits(node.inner, scope), node.tests)
        raise TypeError(node)

    def runs(self, node: cql.Node, scope: Column | None) -> DataFrame:
        """positions with run_start and run_end: the unbroken stretch within the document."""
        key = (node, str(scope))
        if key not in self.runs_of:
            p = self.positions(node, scope, lenient=True)
            island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_idx").orderBy("pos"))
            w = Window.partitionBy("doc_idx", "__island")
            self.runs_of[key] = p.withColumn("__island", island).withColumns({"run_start": F.min("pos").over(w), "run_end": F.max("pos").over(w) + 1}).drop("__island")
        return self.runs_of[key]

    def sequence(self, steps: list[Step], scope: Column | None) -> DataFrame:
        apart = any(not s.single or s.any_token or s.negative for s in steps)  # else matches may run across documents
        first, rest = steps[0], steps[1:]
        front = self._first(first, rest, scope)
        width = 1 if first.single else None
        while rest:
            s, rest = rest[0], rest[1:]
            if s.any_token and not s.single and rest and rest[0].single and not rest[0].any_token:
                front, width = self._once(self._leap(front, s, rest[0], scope)), None
                rest = rest[1:]
                continue
            front = self._extend(front, s, apart, width, scope)
            if not s.single:
                front = self._once(front)
            width = width + 1 if width is not None and s.single else None
        return front if width is not None else front.where(F.col("end_pos") > F.col("start_pos"))

    def _first(self, s: Step, rest: list[Step], scope: Column | None) -> DataFrame:
        def rows(df: DataFrame, end: Column) -> DataFrame:
            out = df.select(F.col("pos").alias("start_pos"), end.alias("end_pos"), *PLACE)
            return self._captured(out, s, F.col("start_pos"))

        least = max(s.least, 1)
        if s.single:
            return rows(self.positions(s.node, scope, lenient=True), F.col("pos") + 1)
        runs = self.scoped(scope).withColumn("run_end", F.col("doc_end")) if s.any_token else self.runs(s.node, scope)
        if least > s.widest:
            found = rows(runs.where(F.lit(False)), F.col("pos"))
        else:
            ends = F.sequence(F.col("pos") + least, F.least("run_end", F.col("pos") + s.widest))
            found = rows(runs.where(F.col("pos") + least <= F.col("run_end")), F.explode(ends))
        if s.least == 0 and rest:
            if self.options.epsilon == "standard":
                seeds = self.scoped(scope)
            elif rest[0].any_token:
                seeds = self.scoped(scope).withColumn("__nr", F.row_number().over(Window.partitionBy("doc_idx").orderBy("pos"))).where("__nr = 1")
            else:
                seeds = self.runs(rest[0].node, scope).where("pos = run_start")
            found = found.union(rows(seeds, F.col("pos")))
        return found

    def _captured(self, df: DataFrame, s: Step, since: Column) -> DataFrame:
        return df if s.label is None else df.withColumns({cap(s.label, "start"): since, cap(s.label, "end"): F.col("end_pos")})

    def _extend(self, front: DataFrame, s: Step, apart: bool, width: int | None, scope: Column | None) -> DataFrame:
        least, after = max(s.least, 1), F.col("end_pos")
        keep = front.columns
        if least > s.widest:
            longer = front.where(F.lit(False)).withColumn("__from", after)
        elif s.any_token:
            longer = front.where(after + least <= F.col("doc_end")).withColumn("__from", after)
            if s.single:
                longer = longer.withColumn("end_pos", after + 1)
            else:
                longer = longer.withColumn("end_pos", F.explode(F.sequence(after + least, F.least("doc_end", after + s.widest))))
        else:
            at = self.positions(s.node, scope, lenient=True) if s.single else self.runs(s.node, scope)
            at = at.select(F.col("pos").alias("__pos"), F.col("doc_idx").alias("__doc"), *([] if s.single else ["run_end"]))
            if width is not None:
                at = at.withColumn("__at", F.col("__pos") - width)
                on = F.col("start_pos") == F.col("__at")
            else:
                on = after == F.col("__pos")
            longer = front.join(at, on & (F.col("doc_idx") == F.col("__doc")) if apart else on).withColumn("__from", after)
            if s.single:
                longer = longer.withColumn("end_pos", after + 1)
            else:
                longer = longer.where(after + least <= F.col("run_end")).withColumn("end_pos", F.explode(F.sequence(after + least, F.least("run_end", after + s.widest))))
        longer = self._captured(longer.select(*keep, "__from"), s, F.col("__from")).drop("__from")
        if s.least > 0:
            return longer
        return longer.union(self._captured(front, s, after))

    def _leap(self, front: DataFrame, gap: Step, s: Step, scope: Column | None) -> DataFrame:
        """A gap of any tokens and the step after it at once: the step's positions within reach are found by buckets of
        positions, of which a gap touches two at most, instead of making every width of the gap."""
        keep = front.columns
        least, most = F.col("end_pos") + gap.least, F.least(F.col("end_pos") + gap.widest, F.col("doc_end") - 1)
        bucket = lambda c: F.floor(c / BUCKET)
        near = front.where(least <= most).withColumns({"__lo": least, "__hi": most}).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi")))))
        at = self.positions(s.node, scope, lenient=True).select(F.col("pos").alias("__pos"), F.col("doc_idx").alias("__doc"), bucket(F.col("pos")).alias("__at"))
        met = near.join(at, (F.col("__bucket") == F.col("__at")) & (F.col("doc_idx") == F.col("__doc")) & F.col("__pos").between(F.col("__lo"), F.col("__hi")))
        if gap.label is not None:
            met = met.withColumns({cap(gap.label, "start"): F.col("end_pos"), cap(gap.label, "end"): F.col("__pos")})
            keep = [*keep, cap(gap.label, "start"), cap(gap.label, "end")]
        return self._captured(met.withColumn("end_pos", F.col("__pos") + 1).select(*keep, "__pos"), s, F.col("__pos")).drop("__pos")

    def _once(self, front: DataFrame) -> DataFrame:
        """One row per span; of several captures the least."""
        caps = [c for c in front.columns if c.startswith("cap_")]
        if not caps:
            return front.distinct()
        keys = [c for c in front.columns if c not in caps]
        return front.groupBy(*keys).agg(F.min(F.struct(*caps)).alias("__c")).select(*keys, *[F.col(f"__c.{c}").alias(c) for c in caps])

    def conditions(self, hits: DataFrame, tests: tuple) -> DataFrame:
        kept = set(captures(hits))
        wanted: dict[str, set[str]] = {}
        for t in tests:
            for label in (t.left, t.right) if isinstance(t, cql.Distance) else (t.left[0], t.right[0]):
                if label not in kept:  # a label within a group has no span here
                    return hits.where(F.lit(False))
            if isinstance(t, cql.Same):
                for label, layer in (t.left, t.right):
                    if layer not in self.corpus.layers or layer == "head":
                        return hits.where(F.lit(False))
                    wanted.setdefault(label, set()).add(layer)
        out = hits
        for t in tests:
            if isinstance(t, cql.Distance):
                d = spans.distance(F.col(cap(t.left, "end")), F.col(cap(t.right, "start")))
                out = out.where({">=": d >= t.value, "<=": d <= t.value, ">": d > t.value, "<": d < t.value, "=": d == t.value, "!=": d != t.value}[t.op])
        name = lambda label, layer: f"__{label}__{layer}".replace(".", "_")
        if wanted:
            values = self.corpus.tokens(*sorted(set().union(*wanted.values())))
        for label, layers in wanted.items():
            own = values.select(F.col("pos").alias(f"__{label}"), *[F.col(f"`{x}`").alias(name(label, x)) for x in sorted(layers)])
            out = out.join(own, F.col(cap(label, "start")) == F.col(f"__{label}"))
        for t in tests:
            if isinstance(t, cql.Same):
                a, b = F.col(name(*t.left)), F.col(name(*t.right))
                out = out.where(a == b if t.equal else a != b)
        return out.select(hits.columns)

    def project(self, hits: DataFrame, alignment: str) -> DataFrame:
        """Targets of the sentences that hold a hit, each once."""
        meta = need_alignment(self.corpus, alignment)
        units, docs = self.corpus.sentences, self.corpus.documents
        if meta["source_layer"] != "sentence" or meta["target_layer"] != "sentence":
            return hits.where(F.lit(False)).select("start_pos", "end_pos", *PLACE)
        src = docs.where(F.col("comp") == meta["source_component"]).select("doc_idx", F.col("doc_in_comp").alias("src_doc"))
        found = hits.where((F.col("comp") == meta["source_component"]) & (F.col("end_pos") <= F.col("sent_end"))).select("doc_idx", "sent_idx").distinct()
        at = found.join(units.select("sent_idx", F.col("sent_in_doc").alias("src_sent")), "sent_idx").join(src, "doc_idx")
        edges = self.corpus.alignment_edges.where(F.col("align_name") == alignment)
        return resolve_targets(self.corpus, at.join(edges, ["src_doc", "src_sent"]).select("tgt_doc", "tgt_sent").distinct(), meta)


def need_alignment(corpus: Corpus, name: str) -> dict:
    rows = corpus.alignment_meta.where(F.col("align_name") == name).limit(1).collect()
    if not rows:
        raise UnknownAlignment(f"no alignment {name}")
    meta = rows[0].asDict()
    known = {r.comp for r in corpus.components.where(F.col("comp").isin(meta["source_component"], meta["target_component"])).select("comp").collect()}
    for side in ("source", "target"):
        if meta[f"{side}_component"] not in known:
            raise ExecutionError(f"{side} component of {name} isn't in the corpus: {meta[f'{side}_component']}")
    return meta


def resolve_targets(corpus: Corpus, units: DataFrame, meta: dict) -> DataFrame:
    """Hits of the target sentences (tgt_doc, tgt_sent); those that don't exist are left out."""
    docs = corpus.documents.where(F.col("comp") == meta["target_component"]).select("doc_idx", F.col("doc_in_comp").alias("tgt_doc"), "comp", F.col("end_pos").alias("doc_end"))
    sents = corpus.sentences.select("doc_idx", F.col("sent_in_doc").alias("tgt_sent"), "sent_idx", "start_pos", "end_pos")
    more = [c for c in units.columns if c not in ("tgt_doc", "tgt_sent")]
    return units.join(docs, "tgt_doc").join(sents, ["doc_idx", "tgt_sent"]).select("start_pos", "end_pos", "doc_idx", "sent_idx", "comp", F.col("end_pos").alias("sent_end"), "doc_end", *more)


def run(corpus: Corpus, query: str | cql.Node, options: Options = Options()) -> DataFrame:
    """Hits of a query, each span once, in no order."""
    node = cql.parse(query) if isinstance(query, str) else query
    return Compiler(corpus, node, options).hits(node)


def explain(corpus: Corpus, query: str, mode: str = "formatted") -> str:
    """The tree of a query and its physical plan."""
    node = cql.parse(query)
    df = run(corpus, node)
    return f"{node}\n\n{df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)}"
