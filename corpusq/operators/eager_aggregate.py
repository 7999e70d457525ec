"""Join results per key without joining rows: eager aggregation.

When a few keys hold most of the rows, a join makes the product of their rows in a few tasks. Here both inputs are first
aggregated by join key (partial sums leave each task, so a hot key costs one small row per task), the compact states
are joined, and products give what the full join would: counts are multiplied, sums of one side are multiplied by the
count of the other. A last roll-up drops the join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _states(df: DataFrame, on: list[str], by: list[str], sums: list[str], side: str, count: str | None) -> DataFrame:
    """By key and group: number of rows and sums. `count`: a column with the rows that a row stands for already."""
    n = F.sum(count) if count else F.count(F.lit(1))
    keys = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(on)]
    groups = [F.col(f"`{c}`").alias(f"__{side}g{i}") for i, c in enumerate(by)]
    return df.groupBy(*keys, *groups).agg(n.alias(f"__{side}n"), *[F.sum(F.col(f"`{c}`")).alias(f"__{side}s{i}") for i, c in enumerate(sums)])


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: list[str], by_left: list[str] = (), by_right: list[str] = (), sum_left: list[str] = (), sum_right: list[str] = (), how: str = "inner", count_left: str | None = None, count_right: str | None = None, salts: int = 1, by_key: bool = False) -> DataFrame:
    """GROUP BY by_left, by_right over `left` JOIN `right` USING (on): n_rows, sum_<c> for each summed column.

    A group column is named as in its table; the two tables' group columns must differ in name. `how` is inner, left or full.
    NULL keys match nothing, as in SQL, and with `left` or `full` are kept with NULL groups of the other side. Sums ignore NULLs
    and are NULL where all are. Empty inputs give no rows. With `count_left` or `count_right`, rows of that side are states
    themselves, standing for that many rows (its sums then cover all of them).

    `by_key` keeps the join key: its columns, n_left and n_right, the rows of either side (NULL where a side has none), come
    too. `salts`: a key may have so many groups on the left that their states, few for each row as they are, are still too
    many for one task; they are dealt to so many parts, and the right side's states, which should be few, repeated for each.
    """
    by_left, by_right, sum_left, sum_right = list(by_left), list(by_right), list(sum_left), list(sum_right)
    if clash := set(by_left) & set(by_right):
        raise ValueError(f"group columns of both sides: {sorted(clash)}")
    if how not in ("inner", "left", "full"):
        raise ValueError(how)
    if salts > 1 and how == "full":
        raise ValueError("a full join can't be salted: states without a partner would count once per part")
    a = _states(left, on, by_left, sum_left, "l", count_left)
    b = _states(right, on, by_right, sum_right, "r", count_right)
    keys = [f"__k{i}" for i in range(len(on))]
    if salts > 1:
        a = a.withColumn("__salt", F.pmod(F.xxhash64(*[f"__lg{i}" for i in range(len(by_left))], F.lit(0)), F.lit(salts)))
        b = b.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    joined = a.join(b, [*keys, *(["__salt"] if salts > 1 else [])], how)
    n_left, n_right = F.coalesce(F.col("__ln"), F.lit(1)), F.coalesce(F.col("__rn"), F.lit(1))
    groups = [F.col(f"__lg{i}").alias(c) for i, c in enumerate(by_left)] + [F.col(f"__rg{i}").alias(c) for i, c in enumerate(by_right)]
    groups += [F.col(k).alias(c) for k, c in zip(keys, on, strict=True)] if by_key else []
    return joined.groupBy(*groups).agg(
        F.sum(n_left * n_right).alias("n_rows"),
        *([F.sum("__ln").alias("n_left"), F.sum("__rn").alias("n_right")] if by_key else []),
        *[F.sum(F.col(f"__ls{i}") * n_right).alias(f"sum_{c}") for i, c in enumerate(sum_left)],
        *[F.sum(F.col(f"__rs{i}") * n_left).alias(f"sum_{c}") for i, c in enumerate(sum_right)],
    )
