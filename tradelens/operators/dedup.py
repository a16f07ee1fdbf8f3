"""Latest version of each record, and incremental set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Null key values form keys of their own.

    Filters that must see the winner (a later amendment may remove a record) go after this.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored. Place it below any expensive parse."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def in_universe(df: DataFrame, universe: DataFrame | None, ticker: str = "ticker") -> DataFrame:
    """Rows whose ticker is listed; no universe lets everything through."""
    if universe is None:
        return df
    listed = universe.select(F.col(universe.columns[0]).alias(ticker)).distinct()
    some = listed.agg(F.count("*").alias("_listed")).withColumn("_one", F.lit(1))  # one row: an empty universe lets everything through as well
    marked = df.join(listed.withColumn("_in", F.lit(True)), ticker, "left").withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one")
    return marked.where(F.col("_in") | (F.col("_listed") == 0)).select(*df.columns)


def high_water_mark(stored: DataFrame, column: str) -> DataFrame:
    return stored.agg(F.max(column).alias(column))
