"""Bounded samples that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters that a sample may hold.
MAX_CHARS = 100_000_000


def bounded_sample(df: DataFrame, key: str, text: str, max_rows: int, max_chars: int = MAX_CHARS) -> DataFrame:
    """Whole rows of `df`, the first by hash of the key, as many as stay within both bounds. The choice depends on keys and
    lengths only, not on the order or number of the partitions. Rows without text are left out."""
    known = df.where(F.col(text).isNotNull())
    sized = known.select(F.col(key).alias("__key"), F.length(text).cast("long").alias("__size"), F.xxhash64(key).alias("__at"))
    first = sized.orderBy("__at", "__key", "__size").limit(max_rows)
    upto = F.sum("__size").over(Window.orderBy("__at", "__key", "__size").rowsBetween(Window.unboundedPreceding, 0))  # max_rows numbers
    chosen = first.withColumn("__upto", upto).where(F.col("__upto") <= max_chars).select("__key").distinct()
    return known.join(F.broadcast(chosen), known[key].eqNullSafe(chosen["__key"])).drop("__key").orderBy(F.xxhash64(key), key, text)
