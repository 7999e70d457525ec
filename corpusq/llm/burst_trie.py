"""Frequency of every distinct term by burst tries.

A burst trie keeps terms in small containers at the ends of a trie over their first characters; a container that grows
beyond its capacity bursts into one container per next character. Prefixes under which more than a set share of a layer's
rows lie are burst beforehand; a term's route is its shortest prefix that is not. Rows go to the task of their route, and
if a route still holds too much (one term with most rows) to one of several by record, so each task holds one range of
prefixes and counts occurrences and records in tries of its own. A task whose tries grow large hands their subtrees on.
Matching subtrees of all tasks are merged by route.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: A route holds at most about this share of a layer's rows, or half a shuffle partition's if that is less; prefixes are burst
#: up to this length. Both bound the table of burst prefixes that goes to every task: PREFIX / share entries a layer.
SHARE, PREFIX = 1 / 64, 4
#: A task hands its subtrees on when they hold so many terms, and adds up states of one range in steps of about so many rows.
HELD_TERMS, STEP_ROWS = 500_000, 65_536
SUBTREE = "layer string, prefix string, terms array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """term -> (occurrences, records). Inner nodes are dicts by next character; containers are dicts by whole term
    marked by their class; terms that end at an inner node are under the empty character."""

    class Container(dict):
        __slots__ = ()

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.root = capacity, BurstTrie.Container()

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, above, depth = self.root, None, 0
        while type(node) is dict:
            above, key = node, term[depth : depth + 1]
            depth += 1
            node = above.get(key)
            if node is None:
                node = above[key] = BurstTrie.Container()
        had = node.get(term)
        node[term] = (occurrences, records) if had is None else (had[0] + occurrences, had[1] + records)
        if len(node) > self.capacity:
            split: dict = {}
            for t, n in node.items():
                split.setdefault(t[depth : depth + 1], BurstTrie.Container())[t] = n
            if above is None:
                self.root = split
            else:
                above[key] = split

    def containers(self) -> Iterator[tuple[str, dict]]:
        """(prefix, container) in the order of prefixes."""
        stack: list[tuple[str, dict]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                stack += [(prefix + c, node[c]) for c in sorted(node, reverse=True)]
            elif node:
                yield prefix, node


def route_of(term: str, burst: dict[str, int]) -> str:
    """The shortest prefix that is not burst, or the whole term."""
    k = 0
    while k < len(term) and term[:k] in burst:
        k += 1
    return term[:k]


def burst_prefixes(values: DataFrame) -> dict[str, dict[str, int]]:
    """Per layer the prefixes that hold more than SHARE of its rows, with the number of tasks that so many rows ask for."""
    by = values.where("term IS NOT NULL").groupBy("layer", F.substring("term", 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = by.select("layer", F.explode(F.transform(F.sequence(F.lit(0), F.length("p")), lambda k: F.substr("p", F.lit(1), k))).alias("p"), "n").groupBy("layer", "p").agg(F.sum("n").alias("n"))
    share = min(SHARE, 0.5 / int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = each.where("p = ''").select("layer", F.col("n").alias("total"))
    heavy = each.join(F.broadcast(total), "layer").where(F.col("n") > F.col("total") * share)  # a row per layer
    out: dict[str, dict[str, int]] = {}
    for r in heavy.select("layer", "p", F.ceil(F.col("n") / (F.col("total") * share)).alias("tasks")).collect():
        out.setdefault(r.layer, {})[r.p] = r.tasks
    return out


def _subtrees(layer: str, trie: BurstTrie) -> Iterator[tuple]:
    for prefix, node in trie.containers():
        terms = sorted(node)
        yield layer, prefix, terms, [node[t][0] for t in terms], [node[t][1] for t in terms]


_SCHEMA = pa.schema([("layer", pa.string()), ("prefix", pa.string()), ("terms", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _router(burst: dict[str, dict[str, int]]):
    """Rows of layer, term, record to states with their number n, the route and the shard of the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[str, int]] = {}
        for b in _steps(batches):
            t = pa.Table.from_batches(b).group_by(["layer", "term", "record"]).aggregate([([], "count_all")])
            layer, term = (t[c].combine_chunks().dictionary_encode() for c in ("layer", "term"))
            layers, terms = layer.dictionary.to_pylist(), term.dictionary.to_pylist()
            code = layer.indices.to_numpy().astype(np.int64) * len(terms) + term.indices.to_numpy()
            pairs, inv = np.unique(code, return_inverse=True)
            routes, shards = [], np.empty(len(pairs), np.int64)
            for i, c in enumerate(pairs.tolist()):
                key = layers[c // len(terms)], terms[c % len(terms)]
                if key not in known:
                    if len(known) > HELD_TERMS:
                        known.clear()
                    own = burst.get(key[0], {})
                    route = route_of(key[1], own)
                    known[key] = route, own.get(route[:PREFIX], 1)  # beyond PREFIX a single term may still be frequent
                r, shards[i] = known[key]
                routes.append(r)
            record = pc.fill_null(t["record"], -1).to_numpy()
            shard = (record * 0x9E3779B1 >> 7) % shards[inv]
            yield pa.RecordBatch.from_arrays([t["layer"].combine_chunks(), pa.array(routes, pa.string()).take(pa.array(inv)), pa.array(shard, pa.int32()), t["term"].combine_chunks(), t["record"].combine_chunks(), t["count_all"].combine_chunks()], schema=_STATES)

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= STEP_ROWS:
            yield held
            held, n = [], 0
    if n:
        yield held


_STATES = pa.schema([("layer", pa.string()), ("route", pa.string()), ("shard", pa.int32()), ("term", pa.string()), ("record", pa.int64()), ("n", pa.int64())])
_STATES_SQL = "layer string, route string, shard int, term string, record bigint, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States arrive sorted by layer, route and record. A record's states are added up before they count as one."""
    tries: dict[tuple[str, str], BurstTrie] = {}
    n_terms = 0

    def add(t: pa.Table) -> int:
        once = t.group_by(["layer", "route", "term", "record"]).aggregate([("n", "sum")])
        g = once.group_by(["layer", "route", "term"]).aggregate([("n_sum", "sum"), ("record", "count")])
        new = 0
        for layer, route, term, n, r in zip(*[g[c].to_pylist() for c in ("layer", "route", "term", "n_sum_sum", "record_count")], strict=True):
            if (layer, route) not in tries:
                tries[layer, route] = BurstTrie()
            tries[layer, route].add(term, n, r)
            new += 1
        return new

    def done() -> Iterator[pa.RecordBatch]:
        for (layer, route), trie in tries.items():
            for _, _, *lists in _subtrees(layer, trie):
                yield _batch([(layer, route, *lists)], _SCHEMA)
        tries.clear()

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < STEP_ROWS:
            continue
        t = pa.Table.from_batches(held)
        last = pc.and_(pc.and_(pc.equal(t["layer"], t["layer"][-1]), pc.equal(t["route"], t["route"][-1])), pc.equal(pc.fill_null(t["record"], -1), pc.fill_null(t["record"][-1], -1)))
        cut = pc.index(last, True).as_py()  # where the last, perhaps unfinished record begins
        if cut:
            n_terms += add(t.slice(0, cut))
            t = t.slice(cut)
        if len(t) >= STEP_ROWS:  # one record alone: no more states than it has terms in this range
            t = t.group_by(["layer", "route", "shard", "term", "record"]).aggregate([("n", "sum")]).rename_columns(["layer", "route", "shard", "term", "record", "n"]).select(_STATES.names).cast(_STATES)
        held, rows = t.to_batches(), len(t)
        if n_terms > HELD_TERMS:
            yield from done()
            n_terms = 0
    if held:
        add(pa.Table.from_batches(held))
    yield from done()


_COUNTS = pa.schema([("layer", pa.string()), ("term", pa.string()), ("n_positions", pa.int64()), ("n_records", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees arrive sorted by layer and route; each route's are merged in one trie."""
    trie, at = BurstTrie(), None

    def done() -> Iterator[pa.RecordBatch]:
        for _, node in trie.containers():
            terms = sorted(node)
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(terms)), pa.array(terms), pa.array([node[t][0] for t in terms], pa.int64()), pa.array([node[t][1] for t in terms], pa.int64())], schema=_COUNTS)

    for b in batches:
        for layer, route, terms, occ, rec in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if at != (layer, route):
                if at is not None:
                    yield from done()
                trie, at = BurstTrie(), (layer, route)
            for t, o, r in zip(terms, occ, rec, strict=True):
                trie.add(t, o, r)
    if at is not None:
        yield from done()


def term_frequencies(values: DataFrame, record: str, route_source: DataFrame | None = None) -> DataFrame:
    """layer, term, n_positions, n_records from rows of layer, term, `record` (an integer).

    n_positions counts rows, n_records distinct `record` values holding the term; a NULL record counts as a position in
    no record. NULL terms are left out; the empty string is a term. Empty input, empty output. `route_source`: rows of layer
    and term that are cheaper to read than `values`; only how the work is shared out depends on them.
    """
    burst = burst_prefixes(values if route_source is None else route_source)
    rows = values.where("term IS NOT NULL").select("layer", "term", F.col(record).cast("bigint").alias("record"))
    states = rows.mapInArrow(_router(burst), _STATES_SQL).repartition("layer", "route", "shard").sortWithinPartitions("layer", "route", "record")
    subtrees = states.mapInArrow(_count, SUBTREE)
    return subtrees.repartition("layer", "prefix").sortWithinPartitions("layer", "prefix").mapInArrow(_merge, "layer string, term string, n_positions bigint, n_records bigint")


def verdicts(counts: DataFrame, n_records: int, rare_positions: int = 2, common_share: tuple[int, int] = (1, 3)) -> DataFrame:
    """`counts` with verdict: rare (at most `rare_positions` positions), else common (in more than the share of all records), else NULL."""
    part, whole = common_share
    return counts.withColumn("verdict", F.expr(f"CASE WHEN n_positions <= {rare_positions} THEN 'rare' WHEN n_records * {whole} > {n_records} * {part} THEN 'common' END"))
