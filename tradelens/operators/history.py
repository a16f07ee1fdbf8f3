"""What an actor did before: earlier purchases, routine months, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_purchases(df: DataFrame, actor: list[str], date: str = "transaction_date") -> DataFrame:
    """Add ``prior_date`` (latest strictly earlier purchase within 365 days) and ``timing``, exactly one of
    sequenced_buying_30d, prior_purchase_31_365d and first_purchase_12mo. One sort, no self-join."""
    before = f"PARTITION BY {', '.join(f'`{a}`' for a in actor)} ORDER BY `{date}` RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    last = F.expr(f"max(`{date}`) OVER ({before})")  # by the date itself: rows in its order are not sorted again; a frame that only grows is not scanned anew for each row
    out = df.withColumn("prior_date", last).withColumn("prior_date", F.when(F.date_diff(date, "prior_date") <= 365, F.col("prior_date")))
    gap = F.date_diff(date, "prior_date")
    return out.withColumn("timing", F.when(gap <= 30, "sequenced_buying_30d").when(gap.isNotNull(), "prior_purchase_31_365d").otherwise("first_purchase_12mo"))


def routine_flags(df: DataFrame, actor: list[str], date: str = "transaction_date", last_day: int = 28, years: int = 3, least: int = 2) -> DataFrame:
    """Add ``routine``: bought in the same month (up to day ``last_day``) of ``least`` of the ``years`` years before.

    Null where no earlier year is covered by the actor's history. The months are gathered per actor in
    distinct form (at most twelve entries a year), so no group grows with the data. The window keeps to a
    partitioning by actor: rows that have it already are neither shuffled nor sorted.
    """
    year, of_actor = F.year(date), Window.partitionBy(*actor)
    month = lambda k: (year - k) * 12 + F.month(date)
    held = df.withColumn("_first", F.min(date).over(of_actor)).withColumn("_months", F.collect_set(F.when(F.dayofmonth(date) <= last_day, month(0))).over(of_actor))
    covered = [F.year("_first") <= year - k for k in range(1, years + 1)]
    bought = [c & F.array_contains("_months", month(k)) for k, c in zip(range(1, years + 1), covered)]
    n = sum((b.cast("int") for b in bought), F.lit(0))
    return held.withColumn("routine", F.when(covered[0], n >= least)).drop("_months", "_first")


def fill_routine(df: DataFrame, actor: list[str], stored: str = "is_routine", **kw) -> DataFrame:
    """Keep a stored flag, fill a missing one; undetermined stays null."""
    return routine_flags(df, actor, **kw).withColumn(stored, F.coalesce(stored, "routine")).drop("routine")


def buying_episodes(df: DataFrame, actor: list[str], date: str = "transaction_date", gap: int = 30, value: str = "total_value") -> DataFrame:
    """Runs of purchases by one actor with at most ``gap`` days between neighbours."""
    w = Window.partitionBy(*actor).orderBy(date)
    starts = (F.coalesce(F.date_diff(date, F.lag(date).over(w)), F.lit(gap + 1)) > gap).cast("int")
    marked = df.withColumn("_start", starts)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    episode = marked.withColumn("_episode", F.sum("_start").over(upto))
    return episode.groupBy(*actor, "_episode").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n_purchases"), F.sum(value).alias("value")).drop("_episode")
