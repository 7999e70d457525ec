"""Hits in order, by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.ordering import running_offsets


def ranked(hits: DataFrame) -> DataFrame:
    """Hits with hit_idx, their number in the order of (start_pos, end_pos); no task sees all of them."""
    return running_offsets(hits, ["start_pos", "end_pos"], {"hit_idx": None})


def page(ranked_hits: DataFrame, offset: int, limit: int) -> DataFrame:
    return ranked_hits.where((F.col("hit_idx") >= offset) & (F.col("hit_idx") < offset + limit)).orderBy("hit_idx")
