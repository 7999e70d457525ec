"""Rows delivered more than once: the latest delivery of each key is the valid one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_valid(df: DataFrame, key: str | list[str], ts: str = "ingested_at", block: int | None = None) -> DataFrame:
    """One row per key: the one with the greatest `ts`.

    A NULL `ts` is older than any other. Equal `ts` are settled by the greatest row hash, so the choice does not
    depend on row order. Rows with a NULL in the key have no identity and are left out. The rows are partitioned
    by key and need no more memory than a sort: a key's deliveries are never gathered.

    With `block`, for a dense integer key, that many neighbouring keys stay in one partition: what is counted afterwards
    per sentence or document is then mostly added up before the next shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    rank, at = "__delivery_rank", "__key_block"
    valid = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if block:
        valid = valid.withColumn(at, F.floor(F.col(keys[0]) / block)).repartition(at)
    w = Window.partitionBy(*([at] if block else []), *keys).orderBy(F.col(ts).desc_nulls_last(), F.xxhash64(*rest).desc())
    return valid.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank, at)
