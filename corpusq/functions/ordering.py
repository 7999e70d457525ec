"""Global running numbers without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.storage import written


def running_offsets(df: DataFrame, order: list[str], sizes: dict[str, str | None]) -> DataFrame:
    """`df` with a column per entry of `sizes`: the sum of the named size column (None: of ones) over all rows before it.

    Rows are range-partitioned by `order`; running sums are made within partitions and the partitions' totals, one row for
    each partition, are added up apart.
    """
    rows = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    one = {k: F.lit(1).cast("long") if v is None else F.col(v).cast("long") for k, v in sizes.items()}
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(k) for k, c in one.items()])  # as many rows as partitions
    starts = totals.select("__part", *[F.coalesce(F.sum(k).over(over_parts), F.lit(0)).alias(f"__{k}") for k in sizes])
    out = rows.withColumns({f"__in_{k}": F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in one.items()}).join(F.broadcast(starts), "__part")
    return out.withColumns({k: F.col(f"__{k}") + F.col(f"__in_{k}") for k in sizes}).select(*df.columns, *sizes)
