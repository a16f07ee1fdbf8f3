"""Which factors go with returns: matching, lift, bands and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators.ranges import join_in_days

# Score bands.
SCORE_BANDS = [(0, 35), (35, 45), (45, 50), (50, 55), (55, 60), (60, 65), (65, 70), (70, 75), (75, 80), (80, 90), (90, 101)]


def nearest_signals(detail: DataFrame, signals: DataFrame, offset: int = 4, most: int = 8) -> DataFrame:
    """Each return row with the signal whose date lies nearest to entry - offset; ties go to the earlier one.

    detail: ticker, start_date, horizon, excess and a unique row_id. Rows without a match go.
    """
    own = signals.select("ticker", F.col("signal_date").alias("matched_date"), F.col("score").alias("matched_score"), F.col("breakdown").alias("matched_breakdown"))
    near = join_in_days(detail, own, "ticker", "start_date", "matched_date", offset + most, most - offset)
    gap = F.abs(F.date_diff("start_date", "matched_date") - offset)
    w = Window.partitionBy("row_id").orderBy(gap, "matched_date")
    return near.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def factor_lift(matched: DataFrame, factors: list[str]) -> DataFrame:
    """Per horizon and factor: mean excess with and without it. An absent or zero factor is without.

    Means come from sums of whole millionths, so the order of rows never shows in the last digit.
    """
    units = F.round(F.col("excess") * 1_000_000).cast("decimal(38,0)")
    mean = lambda c: F.try_divide(F.sum(F.when(c, units)).cast("double"), F.count_if(c & F.col("excess").isNotNull()) * 1_000_000)
    points = F.map_filter(F.from_json("matched_breakdown", "map<string,int>"), lambda k, v: v != 0)
    rows = matched.select("horizon", "excess", points.alias("_points"))
    sums = []
    for k, f in enumerate(factors):  # each factor a pair of conditional sums; no row is multiplied
        has = F.coalesce(F.map_contains_key("_points", f), F.lit(False))
        sums += [F.count_if(has).alias(f"n{k}"), F.count_if(~has).alias(f"o{k}"), mean(has).alias(f"w{k}"), mean(~has).alias(f"x{k}")]
    per = [F.struct(F.lit(f).alias("factor"), F.col(f"n{k}").alias("n_with"), F.col(f"o{k}").alias("n_without"), F.col(f"w{k}").alias("_w"), F.col(f"x{k}").alias("_o")) for k, f in enumerate(factors)]
    out = rows.groupBy("horizon").agg(*sums).select("horizon", F.explode(F.array(*per)).alias("f")).select("horizon", "f.*")
    return out.select("horizon", "factor", "n_with", "n_without", F.round("_w", 6).alias("avg_with"), F.round("_o", 6).alias("avg_without"), F.round(F.col("_w") - F.col("_o"), 6).alias("lift"))


def lift_ranking(lift: DataFrame, horizon: int) -> DataFrame:
    """The factors of one horizon, best lift first and unknown lifts last; a lift of zero is a value like others."""
    own = lift.where(F.col("horizon") == horizon)
    w = Window.orderBy(F.desc_nulls_last("lift"), "factor")  # one row for each factor
    return own.withColumn("place", F.row_number().over(w)).orderBy("place")


def score_bands(matched: DataFrame, bands=SCORE_BANDS) -> DataFrame:
    label = F.lit(None).cast("string")
    for lo, hi in bands:
        label = F.when((F.col("matched_score") >= lo) & (F.col("matched_score") < hi), F.lit(f"{lo}-{hi}")).otherwise(label)
    return matched.withColumn("band", label).where("band IS NOT NULL").groupBy("horizon", "band").agg(F.count("*").alias("n"), F.round(F.avg("excess"), 4).alias("avg_excess"), F.round(F.coalesce(F.stddev_samp("excess"), F.lit(0.0)), 4).alias("sd"))


def weight_advice(lift: DataFrame, weights: dict[str, int], horizons: tuple[int, ...] = (60, 90)) -> DataFrame:
    """Mean lift over the horizons that have one, and what it says about the factor's weight."""
    from tradelens.functions.columns import lookup

    by = lift.where(F.col("horizon").isin(*horizons)).groupBy("factor").agg(F.avg("lift").alias("_m"), *[F.max(F.when(F.col("horizon") == h, F.col("lift"))).alias(f"lift_{h}") for h in horizons]).where("_m IS NOT NULL")
    m = F.round("_m", 6)
    advice = F.when(m > 5, "raise").when(m > 2, "keep").when(m > 0, "keep, small effect").when(m > -2, "no clear effect").otherwise("lower")
    return by.select("factor", lookup(weights, F.col("factor"), 0).alias("weight"), *[f"lift_{h}" for h in horizons], m.alias("avg_lift"), advice.alias("advice"))
