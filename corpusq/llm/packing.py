"""Filling fixed-capacity containers: best-fit decreasing, certified by lower bounds.

Items are divided by hash into partitions of a bounded number. Each is packed by best-fit decreasing, and dual-feasible
functions give a number of containers that no packing of its items can go below. Where packing and bound
agree the partition is settled. The others keep their full containers and give the documents of all others back; these are
pooled, so that each pool has the documents of several partitions, and packed again. A pool that needs fewer containers than
its documents had takes their place, and rounds go on until none does. The functions' sums add up over partitions, so they
also bound the packing as a whole; every item tells whether its partition is certified.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.storage import written

#: Items packed together in one task.
PARTITION_ITEMS = 20_000
#: Specifications, which are a small table; each document becomes a row for each.
MAX_SPECS = 1_000
K_FUNCTIONS, L_FUNCTIONS = 20, 64


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (0 <= size <= capacity): the fullest in which it fits, larger items first."""
    out = np.empty(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, each once
    n = 0
    small = capacity <= 1 << 16
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if small:
            fit = mask >> s
            room = s + (fit & -fit).bit_length() - 1 if fit else None
        else:
            at = bisect.bisect_left(rooms, s)
            room = rooms[at] if at < len(rooms) else None
        if room is None:
            b, room = n, capacity
            n += 1
        else:
            held = by_room[room]
            b = held.pop()
            if not held:
                del by_room[room]
                if small:
                    mask &= ~(1 << room)
                else:
                    rooms.pop(bisect.bisect_left(rooms, room))
        out[i] = b
        left = room - s
        if left not in by_room:
            by_room[left] = []
            if small:
                mask |= 1 << left
            else:
                bisect.insort(rooms, left)
        by_room[left].append(b)
    return out


def function_sums(sizes: np.ndarray, capacity: int) -> list[int]:
    """Sums over the items of each dual-feasible function, in units in which one container holds `unit(i)`.

    The first K are u(k): floor((k+1)x)/k, or x where (k+1)x is whole; the rest drop items below a limit and
    round those above its complement up to a whole container (limit 0: the plain sum).
    """
    s, n = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    out = []
    for k in range(1, K_FUNCTIONS + 1):
        whole, rest = np.divmod((k + 1) * s, capacity)
        out.append(int((np.where(rest == 0, k * whole, (k + 1) * whole) * n).sum()))
    for limit in limits(capacity):
        out.append(int((np.where(s > capacity - limit, capacity, np.where(s < limit, 0, s)) * n).sum()))
    return out


def limits(capacity: int) -> list[int]:
    return sorted({int(x) for x in np.linspace(0, capacity // 2, L_FUNCTIONS)})


def bound(sums: list[int], capacity: int) -> int:
    """Containers needed at least, from the sums of all functions."""
    unit = [k * (k + 1) for k in range(1, K_FUNCTIONS + 1)] + [capacity] * len(limits(capacity))
    return max((-(-s // u) for s, u in zip(sums, unit, strict=True)), default=0)


_STATE = "spec_name string, capacity bigint, doc_id bigint, piece bigint, start bigint, n_tokens bigint, old string, part bigint, bin bigint, used bigint, gap boolean"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by specification and part."""
    names = ["spec_name", "capacity", "doc_id", "piece", "start", "n_tokens", "old", "part"]

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        sizes, capacity = t["n_tokens"].to_numpy(), t["capacity"][0].as_py()
        bins = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, sizes).astype(np.int64)
        gap = len(used) > bound(function_sums(sizes, capacity), capacity)
        t = t.append_column("bin", pa.array(bins)).append_column("used", pa.array(used[bins])).append_column("gap", pa.array(np.full(len(bins), gap)))
        yield from t.to_batches()

    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b.select(names)
        spec, part = b.column("spec_name").to_numpy(zero_copy_only=False), b.column("part").to_numpy()
        edges = [0, *(np.flatnonzero((spec[1:] != spec[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if at is not None and at != (spec[lo], part[lo]):
                yield from done(held)
                held = []
            at = spec[lo], part[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from done(held)


def _packed(items: DataFrame, counts: dict[str, int], key, per_part: int) -> DataFrame:
    """Items divided by the hash of `key` into parts of about `per_part`, each packed."""
    if not counts:
        return items.sparkSession.createDataFrame([], _STATE)
    parts = F.coalesce(*[F.when(F.col("spec_name") == s, F.lit(-(-n // per_part))) for s, n in counts.items()], F.lit(1))
    spread = items.withColumn("part", F.pmod(key, parts).cast("bigint"))
    return spread.repartition("spec_name", "part").sortWithinPartitions("spec_name", "part", "n_tokens", "doc_id", "piece").mapInArrow(_pack, _STATE)


def _by_spec(df: DataFrame, *what) -> dict[str, tuple]:
    return {r[0]: tuple(r[1:]) for r in df.groupBy("spec_name").agg(*what).collect()}


def items_of(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, capacity, doc_id, piece, start, n_tokens: every document for each specification, cut into pieces of the
    capacity and a rest only if it alone exceeds it. Specifications without a capacity above 0 have no items."""
    s = specs.where("spec_name IS NOT NULL AND capacity_tokens > 0").groupBy("spec_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity")).orderBy("spec_name").limit(MAX_SPECS + 1).collect()
    if len(s) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specifications")
    each = F.array(*[F.struct(F.lit(r.spec_name).alias("spec_name"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in s]) if s else F.expr("CAST(array() AS array<struct<spec_name: string, capacity: bigint>>)")
    pieces = F.explode(F.expr("sequence(0L, greatest(0L, ceil(n_tokens / capacity) - 1))"))
    every = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.explode(each).alias("s")).select("s.*", "doc_id", "n_tokens")
    cut = every.select("spec_name", "capacity", "doc_id", pieces.alias("piece"), "n_tokens")
    return cut.select("spec_name", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.expr("least(capacity, n_tokens - piece * capacity)").alias("n_tokens"))


def pack(sizes: DataFrame, specs: DataFrame, per_part: int = PARTITION_ITEMS) -> DataFrame:
    """spec_name, capacity, container, doc_id, piece, start, n_tokens, certified: every document's place for each
    specification.

    `sizes` has doc_id and n_tokens; `specs` spec_name and capacity_tokens (a table of fixed size). `container` is unique
    within a specification, `start` the piece's first token; `certified` says that the documents packed together with this
    one can't do with fewer containers. Documents without tokens lie in a container too, in its
    remaining room of 0; repeated and NULL ids are items of their own. Rounds are written tables.
    """
    items = written(items_of(sizes, specs), "items")
    out = ["spec_name", "capacity", "container", "doc_id", "piece", "start", "n_tokens", "certified"]
    done = lambda df: df.withColumn("certified", ~F.col("gap")).select(out)
    name = lambda k: F.concat_ws(".", F.lit(k), "part", "bin").alias("container")
    counts = {k: v[0] for k, v in _by_spec(items, F.count(F.lit(1))).items()}
    # row numbers of a written table are the same in every run, so repeated ids are divided too
    first = _packed(items.withColumn("old", F.lit("")), counts, F.xxhash64(F.monotonically_increasing_id()), per_part)
    state = written(first, "packed-0").withColumn("container", name(0))
    settled, k = [], 0
    while True:
        open_ = "gap AND used < capacity"
        again = state.where(open_)
        settled.append(done(state.where(f"NOT ({open_})")))
        k += 1
        had = {s: n for s, (n,) in _by_spec(again, F.count(F.lit(1))).items()}
        if not had or k > 1 and not any(n > per_part for n in had.values()) and alone:
            settled.append(done(again))
            break
        alone = all(n <= per_part for n in had.values())  # one pool each: packing it once more changes nothing
        # whole containers are pooled, those of one partition in several pools
        pooled = written(_packed(again.withColumn("old", F.col("container")).drop("container", "part", "bin", "used", "gap"), had, F.xxhash64("old", F.lit(k)), per_part), f"packed-{k}").withColumn("container", name(k))
        per = pooled.groupBy("spec_name", "part").agg(F.count_distinct("bin").alias("new_n"), F.count_distinct("old").alias("old_n"))
        won = written(per.where("new_n < old_n").select("spec_name", "part"), "gains")  # a row per pool
        if not won.limit(1).count():
            settled.append(done(again))
            break
        better = pooled.join(won, ["spec_name", "part"], "left_semi")
        lost = pooled.join(won, ["spec_name", "part"], "left_anti").withColumn("container", F.col("old"))
        full = better.groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("used"))
        kept = lost.drop("used").join(lost.groupBy("spec_name", "container").agg(F.sum("n_tokens").alias("used")), ["spec_name", "container"])
        cols = ["spec_name", "capacity", "doc_id", "piece", "start", "n_tokens", "container", "used", "gap"]
        state = written(better.drop("used").join(full, ["spec_name", "container"]).select(cols).unionByName(kept.select(cols)), f"state-{k}")
    result = settled[0]
    for s in settled[1:]:
        result = result.unionByName(s)
    return result


_SUMS = "spec_name string, capacity bigint, i int, s bigint"


def lower_bounds(items: DataFrame) -> dict[str, int]:
    """Containers that any packing of all items needs, by specification; the sums are made where the items are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec, cap, n = b.column("spec_name").to_numpy(zero_copy_only=False), b.column("capacity").to_numpy(), b.column("n_tokens").to_numpy()
            for x in np.unique(spec):
                here = spec == x
                c = int(cap[here][0])
                sums = function_sums(n[here], c)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(sums)), pa.array([c] * len(sums), pa.int64()), pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.int64())], names=["spec_name", "capacity", "i", "s"])

    sums: dict[tuple[str, int], list[int]] = {}
    for r in items.select("spec_name", "capacity", "n_tokens").mapInArrow(run, _SUMS).groupBy("spec_name", "capacity", "i").agg(F.sum("s").alias("s")).orderBy("i").collect():
        sums.setdefault((r.spec_name, r.capacity), []).append(r.s)
    return {s: bound(v, c) for (s, c), v in sums.items()}
