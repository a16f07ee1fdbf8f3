"""Suppression of signals that repeat a recent one of the same ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.columns import type_rank
from tradelens.schemas import RULES, Rules


def suppressed(days: Column, score: Column, rank: Column, anchor_score: Column, anchor_rank: Column, rules: Rules = RULES) -> Column:
    """Is a signal covered by its anchor? Not if it is ``cooldown_days`` away, jumps in score or has a higher type."""
    return (F.abs(days) < rules.cooldown_days) & (score < anchor_score + rules.cooldown_jump) & (rank <= anchor_rank)


def greedy(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Scan each ticker's signals by date and keep those that the last kept one does not suppress.

    Whether a row stays depends on the last row that stayed, which no window function expresses: a
    fold over small structs (day, score, rank). A gap of ``cooldown_days`` starts afresh, so each
    episode between gaps is folded by itself, and a ticker's history is never gathered whole.
    """
    w = Window.partitionBy("ticker").orderBy(F.unix_date("signal_date"))
    fresh = F.coalesce(F.date_diff("signal_date", F.lag("signal_date").over(w)) >= rules.cooldown_days, F.lit(True))
    df_in, df = df, df.select("ticker", "signal_date", "score", "signal_type", F.sum(fresh.cast("int")).over(w).alias("_episode"))
    one = F.struct(F.unix_date("signal_date").alias("day"), F.col("score").cast("int").alias("score"), type_rank(F.col("signal_type")).alias("rank"))
    start = F.struct(F.expr("array()").cast("array<int>").alias("kept"), F.lit(-1_000_000).alias("day"), F.lit(0).alias("score"), F.lit(0).alias("rank"))

    def step(acc, x):
        stays = ~suppressed(x.day - acc.day, x.score, x.rank, acc.score, acc.rank, rules)
        return F.when(stays, F.struct(F.concat(acc.kept, F.array(x.day)).alias("kept"), x.day.alias("day"), x.score.alias("score"), x.rank.alias("rank"))).otherwise(acc)

    kept = df.groupBy("ticker", "_episode").agg(F.array_sort(F.collect_list(one)).alias("_all")).select("ticker", F.explode(F.aggregate("_all", start, step, lambda a: a.kept)).alias("_day"))
    return df_in.join(kept.withColumn("signal_date", F.date_from_unix_date("_day")).drop("_day"), ["ticker", "signal_date"], "left_semi")


def _best_neighbour(df: DataFrame, lo: int, hi: int) -> Column:
    """Best (rank, score) among the ticker's signals from lo to hi days away; LOW rows never count."""
    w = Window.partitionBy("ticker").orderBy(F.unix_date("signal_date")).rangeBetween(lo, hi)
    return F.max(F.when(F.col("signal_type") != "LOW", F.struct(type_rank(F.col("signal_type")).alias("rank"), F.col("score").alias("score")))).over(w)


def two_pass(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Drop later signals that are no better than an earlier neighbour; then earlier ones that a later one beats."""
    near, rank = rules.cooldown_days - 1, type_rank(F.col("signal_type"))
    first = df.withColumn("_n", _best_neighbour(df, -near, -1))
    first = first.where(~F.coalesce((rank <= F.col("_n.rank")) & (F.col("score") < F.col("_n.score") + rules.cooldown_jump), F.lit(False))).drop("_n")
    second = first.withColumn("_n", _best_neighbour(first, 1, near))
    return second.where(~F.coalesce((F.col("_n.rank") > rank) | (F.col("_n.score") >= F.col("score") + rules.cooldown_jump), F.lit(False))).drop("_n")


def against_stored(new: DataFrame, stored: DataFrame, rules: Rules = RULES) -> DataFrame:
    """New signals that no stored one within the cooldown, before or after, suppresses."""
    from tradelens.operators.ranges import join_in_days

    near = rules.cooldown_days - 1
    old = stored.where(F.col("signal_type") != "LOW").select("ticker", F.col("signal_date").alias("_date"), F.struct(type_rank(F.col("signal_type")).alias("rank"), F.col("score").alias("score")).alias("_n"))
    best = join_in_days(new.select("ticker", "signal_date"), old, "ticker", "signal_date", "_date", near, near).groupBy("ticker", "signal_date").agg(F.max("_n").alias("_n"))
    rank = type_rank(F.col("signal_type"))
    out = new.join(best, ["ticker", "signal_date"], "left")
    return out.where(~F.coalesce((F.col("score") < F.col("_n.score") + rules.cooldown_jump) & (rank <= F.col("_n.rank")), F.lit(False))).drop("_n")
