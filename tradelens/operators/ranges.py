"""Joins of points to day intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_in_days(items: DataFrame, points: DataFrame, key: str, at: str, date: str, before: int, after: int = 0, how: str = "inner") -> DataFrame:
    """Items with each point of the same key from ``before`` days earlier to ``after`` days later, inclusive.

    Both sides meet on (key, bucket of days): an item is laid into the buckets that its interval
    touches, so a key with a long history is split over its buckets and each pair meets once.
    """
    span = max(1, before + after + 1)
    day = lambda c: F.unix_date(F.col(c))
    lo, hi = F.floor((day(at) - before) / span), F.floor((day(at) + after) / span)
    left = items.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    right = points.withColumn("_bucket", F.floor(day(date) / span)).withColumnRenamed(key, "_key")
    inside = (left[key] == right["_key"]) & (left["_bucket"] == right["_bucket"]) & (day(date) >= day(at) - before) & (day(date) <= day(at) + after)
    return left.join(right, inside, how).drop("_bucket", "_key")


#: Intervals in the width of a cell of ``in_cells`` and ``join_cells``.
WIDTH = 6


def in_cells(points: DataFrame, key: str, date: str, before: int, also: int = 0) -> DataFrame:
    """Points dealt by (key, ``_cell``): the cells of all days up to ``before`` days after them (of their own day, if 0).

    ``also``: the reach that the width of a cell is made for, if it is not ``before``.
    """
    width, day = WIDTH * (max(before, also) + 1), F.unix_date(F.col(date))
    cell = F.floor(day / width)
    cells = F.explode(F.sequence(cell, F.floor((day + before) / width))) if before else cell
    return points.withColumn("_cell", cells).repartition(key, "_cell")


def join_cells(items: DataFrame, laid: DataFrame, key: str, at: str, date: str, before: int, also: int = 0) -> DataFrame:
    """Items with each point of the same key from ``before`` days earlier on; ``laid`` are the points ``in_cells``, with the same ``also``.

    Unlike in ``join_in_days``, an item stands in one cell only, which stays as ``_cell``: what is then grouped
    or ordered by key, cell and item is not shuffled again. Points near an edge are copied instead.
    """
    left = in_cells(items, key, at, 0, max(before, also))
    right = laid.withColumnRenamed(key, "_key").withColumnRenamed("_cell", "_own")
    day = lambda c: F.unix_date(F.col(c))
    inside = (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_own")) & (day(date) >= day(at) - before) & (day(date) <= day(at))
    return left.join(right, inside).drop("_key", "_own")
