"""Parent-child rows to full hierarchies by tree contraction.

The forest of every group is contracted: leaf raking takes off all leaves, unary-chain compression splices
an independent set of nodes with one child out of their chains, in turn, so O(log n) rounds suffice whatever the
depth. Undoing the recorded contractions in reverse gives each node's root, depth, path and number of descendants. What
cannot be contracted to roots is a cycle; everything hanging on it is marked `cyclic`.

Groups of up to `max_local` rows (by default fewer with paths) are contracted many at a time as arrays within a task; larger ones (found by a
count over the group column) are contracted by joins over the whole cluster, by the same two moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusq.functions.storage import written

BATCH_ROWS = 65_536
MAX_LOCAL = 1_000_000
#: With paths, whose total length may be the square of a group's rows: rows of a group that one task takes, and squares added
#: up over the groups that it takes at once.
MAX_LOCAL_PATHS, MAX_SQUARES = 4_000, 1 << 25


def contract(parent: np.ndarray, paths: bool = False) -> dict[str, np.ndarray | list]:
    """Contract the forest in which `parent[i]` is the index of i's parent, -1 for none.

    Gives root (-1 on or below a cycle), depth, below (number of descendants; for a node on a cycle those met before
    the core stopped shrinking) and, if asked for, the path of every node to its root as lists of indices.
    """
    n = len(parent)
    par, dist, acc = parent.astype(np.int64).copy(), np.ones(n, np.int64), np.ones(n, np.int64)
    seg: list | None = [[i] for i in range(n)] if paths else None
    act, log = np.arange(n), []
    rng = np.random.default_rng(7)
    while True:
        has = act[par[act] >= 0]
        kids = np.bincount(par[has], minlength=n)
        leaves = has[kids[has] == 0]
        if leaves.size:
            up = par[leaves]
            log.append((leaves, up, dist[leaves], None))
            acc += np.bincount(up, acc[leaves], n).astype(np.int64)
            kids -= np.bincount(up, minlength=n)
            par_of = np.zeros(n, bool)
            par_of[leaves] = True
            act = act[~par_of[act]]
            has = has[~par_of[has]]
        child = np.full(n, -1)
        child[par[has]] = has
        one = has[(kids[has] == 1) & (par[has] != has)]
        if not one.size:
            if leaves.size:
                continue
            break
        cand = np.zeros(n, bool)
        cand[one] = True
        coin = rng.integers(0, 2, n).astype(bool)
        up = par[one]
        take = one[coin[one] & ~(cand[up] & coin[up])]
        if take.size:
            up, down = par[take], child[take]
            log.append((take, up, dist[take], down))
            acc += np.bincount(up, acc[take], n).astype(np.int64)
            dist[down] += dist[take]
            par[down] = up
            if seg is not None:
                for v, c in zip(take.tolist(), down.tolist(), strict=True):
                    seg[c] = seg[c] + seg[v]
            gone = np.zeros(n, bool)
            gone[take] = True
            act = act[~gone[act]]
    root, depth, below = np.full(n, -1), np.zeros(n, np.int64), acc - 1
    top = act[par[act] < 0]
    root[top] = top
    path: list | None = None
    if paths:
        path = [None] * n
        for v in top.tolist():
            path[v] = [v]
    for nodes, up, d, down in reversed(log):
        root[nodes] = root[up]
        depth[nodes] = depth[up] + d
        if down is not None:
            below[nodes] = acc[nodes] + below[down]
        if path is not None:
            for v, p in zip(nodes.tolist(), up.tolist(), strict=True):
                path[v] = None if path[p] is None else seg[v] + path[p]
    return {"root": root, "depth": depth, "below": below, "path": path}


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Integers that grow with the values."""
    values = column.to_numpy()
    return values.astype(np.int64) if values.dtype.kind in "iu" else np.unique(values, return_inverse=True)[1].astype(np.int64)


def _parents(group: np.ndarray, node: pa.ChunkedArray, parent: pa.ChunkedArray, known: np.ndarray) -> np.ndarray:
    """Index of each row's parent within its group, -1 where there is none; rows are sorted by (group, node)."""
    n = len(group)
    if pa.types.is_integer(node.type):
        v, up = node.to_numpy().astype(np.int64), parent.fill_null(0).to_numpy().astype(np.int64)
    else:
        both = np.unique(np.r_[node.to_numpy(), parent.fill_null("").to_numpy()], return_inverse=True)[1].astype(np.int64)
        v, up = both[:n], both[n:]
    ids = np.cumsum(np.r_[False, group[1:] != group[:-1]]).astype(np.int64)
    lo, span = v.min(), v.max() - v.min() + 1
    inside = known & (up >= lo) & (up < lo + span)
    key, want = ids * span + (v - lo), ids * span + np.where(inside, up - lo, 0)
    at = np.minimum(np.searchsorted(key, want), n - 1)
    return np.where(inside & (key[at] == want), at, -1)


def _local(group: str, node: str, parent: str, label: str | None, out: pa.Schema):
    paths = "path" in out.names

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not paths:
            yield from together(t)
            return
        g = _codes(t[group])
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        share = np.cumsum(np.diff(np.r_[start, len(g)]) ** 2) // MAX_SQUARES
        for lo, hi in zip(cut := start[np.r_[True, share[1:] != share[:-1]]], np.r_[cut[1:], len(g)], strict=True):
            yield from together(t.slice(int(lo), int(hi - lo)))

    def together(t: pa.Table) -> list[pa.RecordBatch]:
        g, v = _codes(t[group]), t[node].to_numpy()
        first = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        if not first.all():
            t, g, v = t.filter(pa.array(first)), g[first], v[first]
        known = t[parent].is_valid().to_numpy()
        r = contract(_parents(g, t[node], t[parent], known), paths)
        ok = r["root"] >= 0
        cols = {"root": pa.array(v[r["root"]], mask=~ok), "depth": pa.array(r["depth"], mask=~ok), "n_below": pa.array(r["below"], mask=~ok), "cyclic": pa.array(~ok)}
        if paths:
            for name, values in (("path", v.tolist()), ("labels", t[label].to_pylist() if label else [])):
                if name in out.names:
                    cols[name] = pa.array([None if p is None else [values[i] for i in p] for p in r["path"]], out.field(name).type)
        return pa.table([(t[f.name] if f.name in t.column_names else cols[f.name]).cast(f.type) for f in out], schema=out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < BATCH_ROWS:
                continue
            t = pa.Table.from_batches(held)
            g = t[group].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # where the last, perhaps unfinished group begins
            if cut:
                yield from solve(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(g) - cut
        if rows:
            yield from solve(pa.Table.from_batches(held))

    return run


def _add(state: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes that stay take over the counts of those taken off below them."""
    gain = gone.groupBy("g", F.col("p").alias("v")).agg(F.sum("acc").alias("gain"))
    return state.join(gain, ["g", "v"], "left").withColumn("acc", F.expr("acc + coalesce(gain, 0)")).drop("gain")


def _children(state: DataFrame) -> DataFrame:
    kids = state.where("p IS NOT NULL").groupBy("g", F.col("p").alias("v")).agg(F.count("*").alias("kids"), F.min("v").alias("child"))
    return state.join(kids, ["g", "v"], "left").withColumn("kids", F.expr("coalesce(kids, 0)"))


def _distributed(rows: DataFrame, lists: list[str]) -> DataFrame:
    """The same contraction by joins, for groups too large for one task. rows: g, v, p and lists, arrays of one item
    each that are joined along the way to the root. Every round's state is a written table."""
    nodes = rows.select("g", F.col("v").alias("p"), F.lit(True).alias("found"))
    cols = ["g", "v", "p", "d", "acc", *lists]
    state = rows.join(nodes, ["g", "p"], "left").withColumn("p", F.expr("CASE WHEN found THEN p END")).withColumns({"d": F.lit(1).cast("long"), "acc": F.lit(1).cast("long")})
    state, log, k = written(state.select(cols), "forest"), [], 0
    while True:
        seen = written(_children(state).withColumn("out", F.expr("p IS NOT NULL AND kids = 0")), "raked")
        gone = seen.where("out").select(*cols, F.expr("CAST(NULL AS BOOLEAN) AS child"))
        if raked := bool(gone.limit(1).count()):
            log.append((gone, False))
            state = written(_add(seen.where("NOT out").select(cols), gone).select(cols), "forest")
        k += 1
        seen = _children(state).withColumns({"chain": F.expr("p IS NOT NULL AND kids = 1 AND p <> v"), "coin": F.expr(f"pmod(xxhash64(g, v, {k}), 2) = 1")})
        above = seen.select("g", F.col("v").alias("p"), F.expr("chain AND coin").alias("busy"))
        seen = written(seen.join(above, ["g", "p"], "left").withColumn("out", F.expr("chain AND coin AND NOT coalesce(busy, false)")), "compressed")
        if not seen.where("chain").limit(1).count():
            if raked:
                continue
            break
        gone = seen.where("out").select(*cols, "child")
        log.append((gone, True))
        hop = gone.select("g", F.col("child").alias("v"), F.col("p").alias("to"), F.col("d").alias("by"), *[F.col(c).alias(f"{c}_on") for c in lists])
        stay = seen.where("NOT out").select(cols).join(hop, ["g", "v"], "left").withColumns({"p": F.expr("coalesce(to, p)"), "d": F.expr("d + coalesce(by, 0)")} | {c: F.expr(f"CASE WHEN to IS NULL THEN {c} ELSE concat({c}, {c}_on) END") for c in lists})
        state = written(_add(stay.select(cols), gone).select(cols), "forest")
    top = "CASE WHEN p IS NULL THEN"
    done = state.select("g", "v", F.expr(f"{top} v END AS root"), F.expr(f"{top} 0L END AS depth"), F.expr("acc - 1 AS n_below"), *[F.expr(f"{top} {c} END AS {c}") for c in lists])
    for gone, chained in reversed(log):
        up = done.select("g", F.col("v").alias("p"), "root", F.col("depth").alias("above"), *[F.col(c).alias(f"{c}_on") for c in lists])
        back = gone.join(up, ["g", "p"])
        under = F.lit(0)
        if chained:
            back, under = back.join(done.select("g", F.col("v").alias("child"), (F.col("n_below") + 1).alias("under")), ["g", "child"]), F.col("under")
        back = back.select("g", "v", "root", F.expr("above + d AS depth"), (F.col("acc") - 1 + under).alias("n_below"), *[F.expr(f"concat({c}, {c}_on) AS {c}") for c in lists])
        done = written(done.unionByName(back), "expanded")
    return done.withColumns({"cyclic": F.expr("root IS NULL"), "n_below": F.expr("CASE WHEN root IS NOT NULL THEN n_below END")})


def resolve_hierarchy(df: DataFrame, group: str, node: str, parent: str, label: str | None = None, paths: bool = True, max_local: int | None = None, size_source: DataFrame | None = None) -> DataFrame:
    """Every column of `df` plus root, depth (0 at a root), n_below, cyclic and, with `paths`, path (node first, root
    last) and, with `label`, labels on the way.

    `node` is unique within `group`; where it is repeated one row (the least by parent and label) stands for it. A parent
    that is NULL or not a node of the group ends the chain. Rows with a NULL group or node are in no hierarchy and left
    out. On and below a cycle root, depth, n_below, path and labels are NULL. Names of added columns must be free in `df`.

    Group sizes are counted over `size_source` if given: a table that is cheaper to read than `df` and has at least as many
    rows of each group.
    """
    max_local = max_local or (MAX_LOCAL_PATHS if paths else MAX_LOCAL)
    clash = {"root", "depth", "n_below", "cyclic", "path", "labels"} & set(df.columns)
    if clash:
        raise ValueError(f"column names in use: {sorted(clash)}")
    df = df.where(F.col(group).isNotNull() & F.col(node).isNotNull())
    added = [T.StructField("root", df.schema[node].dataType), T.StructField("depth", T.LongType()), T.StructField("n_below", T.LongType()), T.StructField("cyclic", T.BooleanType())]
    if paths:
        added.append(T.StructField("path", T.ArrayType(df.schema[node].dataType)))
        if label:
            added.append(T.StructField("labels", T.ArrayType(df.schema[label].dataType)))
    schema = T.StructType([*df.schema.fields, *added])
    big = (df if size_source is None else size_source).groupBy(group).count().where(F.col("count") > max_local).select(group)
    has_big = bool(big.limit(1).count())
    small = df.join(big, group, "left_anti").select(df.columns) if has_big else df
    spread = small.repartition(group).sortWithinPartitions(group, node, parent, *([label] if label else []))
    out = spread.mapInArrow(_local(group, node, parent, label, to_arrow_schema(schema)), schema)
    if not has_big:
        return out
    rest = [c for c in df.columns if c not in (group, node)]
    large = df.join(big, group, "left_semi").groupBy(group, node).agg(F.min_by(F.struct(*rest), F.struct(parent, *([label] if label else []))).alias("row")).select(group, node, "row.*")
    rows = large.select(F.col(group).alias("g"), F.col(node).alias("v"), F.col(parent).alias("p"), *([F.array(node).alias("path")] if paths else []), *([F.array(label).alias("labels")] if paths and label else []))
    solved = _distributed(rows, rows.columns[3:]).withColumnsRenamed({"g": group, "v": node})
    return out.unionByName(large.join(solved, [group, node]).select(schema.names))
