"""Table maintenance: inserts, upserts, replacement of runs, retention. All return DataFrames; writing is apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators.dedup import latest_by_key, not_stored


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows and the new ones whose key is not stored; of new rows with one key the first in ``order``."""
    once = latest_by_key(new, keys, order) if order else new.dropDuplicates(keys)
    return stored.unionByName(not_stored(once, stored, keys), allowMissingColumns=True)


def children_of(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], fill: list[str] = ()) -> DataFrame:
    """Full outer merge by key: ``overwrite`` columns take the new value where the key is in ``new``, ``fill``
    columns the new value if it is not null, all others keep the stored one."""
    s, n = stored.alias("s"), new.withColumn("_new", F.lit(True)).alias("n")
    merged = s.join(n, keys, "full_outer")
    is_new = F.coalesce(F.col("n._new"), F.lit(False))

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in new.columns:
            return F.col(f"s.{c}").alias(c)
        if c in overwrite:
            return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        if c in fill:
            return F.coalesce(f"n.{c}", f"s.{c}").alias(c)
        return F.coalesce(f"s.{c}", f"n.{c}").alias(c)

    return merged.select(*[pick(c) for c in stored.columns])


def mark(stored: DataFrame, keys_df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Set a boolean column on the rows whose key is listed."""
    seen = keys_df.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return stored.join(seen, keys, "left").withColumn(column, F.coalesce(F.col(column), F.lit(False)) | F.coalesce("_seen", F.lit(False))).select(*stored.columns)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` holds (a run is replaced as a whole)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def retained(df: DataFrame, date: str, as_of: Column, months: int = 24) -> DataFrame:
    return df.where(F.col(date) >= F.add_months(as_of, -months))


def retention(filings: DataFrame, children: DataFrame, keys: list[str], date: str, child_date: str, as_of: Column, months: int = 24) -> tuple[DataFrame, DataFrame]:
    """Filings and children within the last ``months``; children go with their filing."""
    kept = retained(filings, date, as_of, months)
    return kept, children_of(retained(children, child_date, as_of, months), kept, keys)


def evolve(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in order; missing ones are null, others stay behind them."""
    have = set(df.columns)
    own = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*own, *[c for c in df.columns if c not in set(schema.fieldNames())])


def read_evolved(spark: SparkSession, paths: list[str], schema: T.StructType, rescued: str | None = None) -> DataFrame:
    """Folders that were written at different times, read under one schema.

    Each folder has its own columns and types, which its files tell. A column it lacks is null; a type that
    has been widened since is cast. Columns that the schema does not name, and values that do not fit its types,
    are kept as JSON in ``rescued`` (null if there is nothing to keep); without it they are left out.
    """
    parts = []
    for path in paths:
        old = spark.read.parquet(path)
        have, names = set(old.columns), set(schema.fieldNames())
        own = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
        rest = [F.col(c) for c in old.columns if c not in names]
        rest += [F.when(F.col(f.name).try_cast(f.dataType).isNull(), F.col(f.name)).alias(f.name) for f in schema.fields if f.name in have and old.schema[f.name].dataType != f.dataType]
        if rescued is not None:
            own.append((F.nullif(F.to_json(F.struct(*rest)), F.lit("{}")) if rest else F.lit(None).cast("string")).alias(rescued))
        parts.append(old.select(*own))
    return reduce(DataFrame.unionByName, parts)


def fetch_windows(lo: Column, hi: Column, days: int = 8) -> Column:
    """Array of non-overlapping (start, end) windows that cover lo to hi, the last day included."""
    starts = F.sequence(lo, hi, F.make_dt_interval(F.lit(days)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), hi).alias("end")))


def capped_windows(df: DataFrame, date: str, start: Column, days: int = 8, cap: int = 10_000) -> DataFrame:
    """Records per fetch window, and whether the source's cap was reached."""
    k = F.floor(F.date_diff(F.col(date), start) / days)
    return df.groupBy(F.date_add(start, (k * days).cast("int")).alias("window_start")).agg(F.count("*").alias("n")).withColumn("capped", F.col("n") >= cap)
