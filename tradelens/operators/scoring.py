"""Factor scores of purchases, and signals made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.columns import lookup
from tradelens.operators.ranges import in_cells, join_cells
from tradelens.schemas import RULES, Rules


def disqualifier(rules: Rules = RULES) -> Column:
    """Why a purchase does not count, or null; needs is_10b51, total_value and routine, and neither prices nor companies."""
    return F.when(F.coalesce("is_10b51", F.lit(False)), "10b5_1_plan").when(F.coalesce("total_value", F.lit(0)) < rules.trivial_value, "trivial_value").when(F.coalesce("routine", F.lit(False)), "routine_trader")


def score_purchases(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Add disqualifier, breakdown (factor to points) and score.

    Needs is_10b51, total_value, routine, is_direct, role_category, cap_tier, shares, shares_after,
    timing, price_per_share and low_52wk. A disqualified row scores 0 with an empty breakdown.
    """
    why = disqualifier(rules)
    points = rules.factor_points
    role = F.coalesce("role_category", F.lit("other"))
    tier = F.coalesce("cap_tier", F.lit("unknown"))
    role_points, cap_points = lookup(rules.role_points, role, 0), lookup(rules.cap_points, tier, 5)
    shares, after = F.coalesce("shares", F.lit(0)).cast("double"), F.coalesce("shares_after", F.lit(0)).cast("double")
    adds = (shares > 0) & (after > shares) & (shares >= 0.05 * (after - shares))
    price, low = F.col("price_per_share").cast("double"), F.col("low_52wk").cast("double")
    above = F.when((low > 0) & (price > 0), (price - low) / low * 100)

    def when(condition: Column, factor: str) -> Column:
        return F.when(condition, F.struct(F.lit(factor).alias("factor"), F.lit(points[factor]).alias("points")))

    timing = F.struct(F.col("timing").alias("factor"), lookup(points, F.col("timing"), 0).alias("points"))
    factors = F.array_compact(
        F.array(
            when(~F.col("is_direct"), "indirect_purchase"),
            F.struct(F.concat(F.lit("role_"), role).alias("factor"), role_points.alias("points")),
            F.when(cap_points > 0, F.struct(F.concat(F.lit("cap_"), tier).alias("factor"), cap_points.alias("points"))),
            when(adds, "holdings_increase_5pct"),
            timing,
            when(above <= 5, "near_52wk_low_5pct"),
            when((above > 5) & (above <= 10), "near_52wk_low_10pct"),
        )
    )
    kept = F.when(why.isNull(), factors).otherwise(F.expr("array()").cast("array<struct<factor:string,points:int>>"))
    out = df.where(F.col("transaction_code").isin("P", "p")).withColumn("disqualifier", why).withColumn("breakdown", F.map_from_entries(kept))
    # the sum of the points of the breakdown, without reading it again
    own = lambda condition, factor: F.when(condition, F.lit(points[factor])).otherwise(0)
    total = own(~F.col("is_direct"), "indirect_purchase") + role_points + F.greatest(cap_points, F.lit(0)) + own(adds, "holdings_increase_5pct") + lookup(points, F.col("timing"), 0)
    total = total + own(above <= 5, "near_52wk_low_5pct") + own((above > 5) & (above <= 10), "near_52wk_low_10pct")
    return out.withColumn("score", F.when(F.col("disqualifier").isNull(), F.least(total, F.lit(100))).otherwise(0))


def signal_class(score: Column, cluster: Column, average: Column, tight: Column, rules: Rules = RULES) -> Column:
    strong = (average >= rules.cluster_average) & (tight | (score >= rules.cluster_best))
    return F.when(cluster, F.when(strong, "CLUSTER_BUY").otherwise("WATCH")).when(score >= rules.buy, "BUY").when(score >= rules.watch, "WATCH").otherwise("LOW")


def step_points(points: dict[int, int], value: Column) -> Column:
    """The points of the greatest step that ``value`` reaches; 0 below the first and for null."""
    out = F.lit(0)
    for step, n in sorted(points.items()):
        out = F.when(value >= step, F.lit(n)).otherwise(out)
    return out


def signals(items: DataFrame, scored: DataFrame, clusters: DataFrame, order: list, rules: Rules = RULES) -> DataFrame:
    """One signal per (ticker, as_of): best score of the scoring window, cluster flags, class and date.

    ``scored`` has one row per purchase outside plans. The score starts at 0, so a window of
    non-positive rows has score 0 and an empty breakdown. A large company's cluster is only watched.
    """
    told = F.when(F.col("score") > 0, F.to_json("breakdown"))  # before the shuffle: the map is twice as long
    held = scored.withColumns({"_told": told, "_counts": F.col("disqualifier").isNull()})
    reach = rules.scoring_days, rules.cluster_days  # cells as wide as those of the clusters: the items are dealt once for both
    laid = in_cells(held, "ticker", "transaction_date", *reach)
    best = Window.partitionBy("ticker", "_cell").orderBy(F.desc("score"), *order)
    laid = laid.select("ticker", "_cell", "transaction_date", "filed_date", "score", "cap_tier", "_counts", F.row_number().over(best).alias("_place"), "_told")
    near = join_cells(items, laid, "ticker", "as_of", "transaction_date", *reach).where("filed_date <= as_of")
    lag = F.date_diff("filed_date", "transaction_date")
    out = near.groupBy("ticker", "_cell", "as_of").agg(
        F.greatest(F.max("score"), F.lit(0)).alias("score"),
        F.min_by("_told", "_place").alias("breakdown"),
        (F.sum(F.when(F.col("_counts"), F.col("score"))) / F.count_if("_counts")).cast("int").alias("_average"),
        F.max("transaction_date").alias("signal_date"),
        F.max("cap_tier").alias("cap_tier"),
        F.min(F.when(lag >= 0, lag)).alias("min_lag"),
        F.count("*").alias("n_purchases"),
    ).drop("_cell")
    out = out.join(clusters, ["ticker", "as_of"], "left").na.fill(False, ["is_cluster", "executive_cluster", "tight_cluster"]).na.fill(0, ["insider_count"])
    bonus = step_points(rules.cluster_size_points, F.col("insider_count")) + step_points(rules.filing_lag_points, F.col("min_lag"))
    out = out.withColumn("score", F.least(F.col("score") + F.when(F.col("score") > 0, bonus).otherwise(0), F.lit(100)))
    kind = signal_class(F.col("score"), F.col("is_cluster"), F.coalesce("_average", "score"), F.col("tight_cluster"), rules)
    out = out.withColumn("signal_type", kind)
    watched = F.when((F.col("signal_type") == "CLUSTER_BUY") & (F.col("cap_tier") == "large"), "WATCH").otherwise(F.col("signal_type"))
    return out.withColumn("signal_type", watched).withColumnRenamed("is_cluster", "cluster_flag").drop("_average")


def one_per_date(found: DataFrame) -> DataFrame:
    """(ticker, signal_date) once: a later filing day overwrites an earlier one."""
    from tradelens.operators.dedup import latest_by_key

    return latest_by_key(found, ["ticker", "signal_date"], [F.desc("as_of")])


