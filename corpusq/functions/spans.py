"""Span expressions over half-open (start, end) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end - start


def is_empty(start: Column, end: Column) -> Column:
    return start == end


def contains(start: Column, end: Column, pos: Column) -> Column:
    return (start <= pos) & (pos < end)


def contains_span(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (start <= inner_start) & (inner_end <= end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def distance(end: Column, other_start: Column) -> Column:
    """From the end of one span to the start of a later one, 0 if it doesn't lie behind."""
    return F.greatest(F.lit(0), other_start - end)
