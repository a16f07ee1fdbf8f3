"""Stored event-study runs: a row per horizon with nested metrics, replaced run by run, read back by the latest date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.operators import event_study, tables

#: A run is a partition of the table.
RUN = ["run_date", "threshold"]
#: What the JSON of a run's metrics holds.
METRICS = """distribution struct<p25: double, median: double, p75: double, max_loss: double, max_gain: double>,
by_score_band array<struct<category: string, n: bigint, hit_rate: double, avg_return: double>>, by_cap_tier array<struct<category: string, n: bigint, hit_rate: double, avg_return: double>>,
by_signal_type array<struct<category: string, n: bigint, hit_rate: double, avg_return: double>>,
risk struct<pct_loss_gt20: double, max_consecutive_losses: bigint, worst_outcome: double, n_no_benchmark: bigint>,
small_caps struct<n: bigint, avg_return: double, hit_rate: double>, weak_clusters struct<n: bigint, hit_rate: double, avg_return: double>,
rolling array<struct<date: date, hit_rate: double, n: bigint>>"""


def run_rows(returns: DataFrame, small_caps: DataFrame, weak_clusters: DataFrame, run_date: str, threshold: int) -> DataFrame:
    """One row per horizon of a run. ``returns`` must be stored; it is read once for each kind of metric.

    What is nested is bounded: categories are fixed, and the rolling rate has a point for every two weeks. The
    trades themselves are not nested; they are a table of their own with the same partitions (``save``).
    """
    strata = event_study.strata(returns)
    one = F.struct("category", "n", "hit_rate", "avg_return")
    nested = strata.groupBy("horizon").agg(*[F.array_sort(F.collect_list(F.when(F.col("dimension") == d, one))).alias(f"by_{d}") for d in event_study.CATEGORIES])
    rolling = event_study.rolling_hit_rate(returns).groupBy("horizon").agg(F.array_sort(F.collect_list(F.struct("date", "hit_rate", "n"))).alias("rolling"))
    small = small_caps.select("horizon", F.struct("n", "avg_return", "hit_rate").alias("small_caps"))
    weak = weak_clusters.select("horizon", F.struct("n", "hit_rate", "avg_return").alias("weak_clusters"))
    out = event_study.summary(returns).join(event_study.risk(returns), "horizon").join(event_study.longest_losing_streak(returns), "horizon", "left")
    for part in (nested, rolling, small, weak):  # a row for each horizon
        out = out.join(part, "horizon", "left")
    spread = F.struct(F.col("p25_return").alias("p25"), F.col("median_return").alias("median"), F.col("p75_return").alias("p75"), "max_loss", "max_gain")
    risk = F.struct("pct_loss_gt20", "max_consecutive_losses", "worst_outcome", "n_no_benchmark")
    metrics = F.to_json(F.struct(spread.alias("distribution"), *[f"by_{d}" for d in event_study.CATEGORIES], risk.alias("risk"), "small_caps", "weak_clusters", "rolling"))
    return out.select(
        F.lit(run_date).cast("date").alias("run_date"), F.lit(threshold).alias("threshold"), F.col("horizon").alias("horizon_days"), F.col("n").alias("n_trades"), "hit_rate", "avg_return", "median_return",
        "p25_return", "p75_return", "sharpe", F.col("small_caps.avg_return").alias("small_cap_avg_return"), metrics.alias("metrics"),
    )


def save(rows: DataFrame, detail: DataFrame, path: str) -> None:
    """Replace a run: its rows and its trades, and no other run's."""
    tables.replace_partitions(rows, f"{path}/runs", RUN)
    keyed = detail.join(F.broadcast(rows.select(*RUN).distinct().limit(1)), how="cross")  # the run's key, one row
    tables.replace_partitions(keyed, f"{path}/detail", RUN)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, with their metrics as a struct."""
    return spark.read.parquet(f"{path}/runs").withColumn("run_date", F.col("run_date").cast("date")).withColumn("metrics", F.from_json("metrics", METRICS))


def latest(stored: DataFrame, order: str = "run_date") -> DataFrame:
    """The rows of the latest run date. The date is found while the query runs and prunes the partitions that are read."""
    return stored.where(F.col(order) == stored.agg(F.max(order)).scalar())


def recent(stored: DataFrame, k: int = 300) -> DataFrame:
    """The newest ``k`` rows over all runs."""
    return stored.orderBy(F.desc("run_date"), "threshold", "horizon_days").limit(k)
