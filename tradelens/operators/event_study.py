"""Event study of signals against benchmark returns, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators import quantiles
from tradelens.operators.prices import as_of_returns

HORIZONS = (30, 60, 90, 180)
# The categories of each dimension.
BANDS = [("35-49", 35, 50), ("50-64", 50, 65), ("65-74", 65, 75), ("75-84", 75, 85), ("85+", 85, 10**6)]
CATEGORIES = {"score_band": [b for b, _, _ in BANDS], "cap_tier": ["small", "mid", "large", "unknown"], "signal_type": ["CLUSTER_BUY", "BUY"]}


def selected(signals: DataFrame, threshold: int = 60, types: tuple[str, ...] = ("BUY", "CLUSTER_BUY")) -> DataFrame:
    return signals.where(((F.col("score") >= threshold) | F.col("cluster_flag")) & F.col("signal_type").isin(*types))


def weak_clusters(signals: DataFrame, threshold: int = 60) -> DataFrame:
    return signals.where((F.col("signal_type") == "CLUSTER_BUY") & (F.col("score") < threshold))


def trades(signals: DataFrame, as_of: Column, horizons: tuple[int, ...] = HORIZONS, lag: int = 3) -> DataFrame:
    """Each signal at each horizon that it is old enough for on ``as_of`` (the horizon and the lag): start_date, end_date."""
    out = signals.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    start = F.coalesce(F.date_add("filed_date", lag + 1), F.date_add("signal_date", lag))
    return old_enough(out.withColumn("start_date", start).withColumn("end_date", F.date_add("start_date", F.col("horizon"))), as_of, lag)


def old_enough(trades: DataFrame, as_of: Column, lag: int = 3) -> DataFrame:
    """The trades whose horizon and lag are over on ``as_of``."""
    return trades.where(F.date_add("signal_date", F.col("horizon") + lag) <= as_of)


def benchmark_returns(spans: DataFrame, benchmark: DataFrame) -> DataFrame:
    """start_date, end_date and bench_ret of distinct spans."""
    return as_of_returns(spans.withColumn("series", F.lit(1)), benchmark.withColumn("series", F.lit(1)), key="series", name="bench_ret").select("start_date", "end_date", "bench_ret")


def excess(ret: Column, base: Column, digits: int | None = 2) -> Column:
    return ret - base if digits is None else F.round(ret - base, digits)


def excess_returns(entered: DataFrame, bars: DataFrame, benchmark: DataFrame, missing: float | None = -50.0, digits: int | None = 2) -> DataFrame:
    """Add ret, bench_ret and excess. Rows without a benchmark return keep a null excess.

    ``missing``: the return of a ticker without prices; None leaves it null.
    """
    own = as_of_returns(entered, bars)
    base = benchmark_returns(entered.select("start_date", "end_date").distinct(), benchmark)
    out = own.join(base, ["start_date", "end_date"], "left")
    ret = F.col("ret") if missing is None else F.coalesce("ret", F.lit(missing))
    return out.withColumn("ret", ret).withColumn("excess", excess(ret, F.col("bench_ret"), digits))


#: The quantiles of the metrics.
QUANTILES = {"median_return": 0.5, "p25_return": 0.25, "p75_return": 0.75}


def metrics(rows: DataFrame, keys: list[str], *more: Column, value: str = "excess") -> DataFrame:
    """Per group: n, hit rate, mean, quartiles, extremes, and the aggregates in ``more``."""
    v = F.col(value)
    out = rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.round(F.avg(F.when(v > 0, 100.0).when(v.isNotNull(), 0.0)), 1).alias("hit_rate"),
        F.round(F.avg(v), 2).alias("avg_return"),
        F.min(v).alias("max_loss"),
        F.max(v).alias("max_gain"),
        *more,
    )
    found = quantiles.exact(rows, keys, value, QUANTILES)
    return out.join(found.select(*keys, *[F.round(c, 4).alias(c) for c in QUANTILES]), keys, "left")


def summary(returns: DataFrame) -> DataFrame:
    """Per horizon: metrics and the Sharpe ratio (null for one trade or no spread)."""
    spread = F.stddev_samp("excess")
    sharpe = F.when(spread > 0, F.avg("excess") / spread * F.sqrt(F.lit(252.0) / F.first("horizon")))
    return metrics(returns.where("excess IS NOT NULL"), ["horizon"], F.round(sharpe, 2).alias("sharpe"))


def band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(BANDS):
        out = F.when((score >= lo) & (score < hi), F.lit(name)).otherwise(out)
    return out


def strata(returns: DataFrame) -> DataFrame:
    """Metrics per horizon by score band, cap tier and signal type, all three in one pass.

    Every category of ``CATEGORIES`` has a row at each horizon, with null metrics and n = 0 if it is empty.
    """
    rows = returns.where("excess IS NOT NULL").select("horizon", "excess", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("category")) for d, c in (("score_band", band(F.col("score"))), ("cap_tier", F.coalesce("cap_tier", F.lit("unknown"))), ("signal_type", F.col("signal_type")))])).alias("s"))
    found = metrics(rows.where("s.category IS NOT NULL").select("horizon", "excess", "s.*"), ["horizon", "dimension", "category"])
    fixed = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("category")) for d, own in CATEGORIES.items() for c in own])
    every = returns.where("excess IS NOT NULL").select("horizon").distinct().select("horizon", F.explode(fixed).alias("c")).select("horizon", "c.*")
    return every.join(found, ["horizon", "dimension", "category"], "left").na.fill(0, ["n"])


def strata_pivot(strata: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per category: the mean return and the number of trades at each horizon, side by side."""
    at = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    cells = [x for h in horizons for x in (at(h, "avg_return").alias(f"avg_{h}"), F.coalesce(at(h, "n"), F.lit(0)).alias(f"n_{h}"))]
    return strata.groupBy("dimension", "category").agg(*cells)


def report_rows(summary: DataFrame, risk: DataFrame) -> DataFrame:
    """Per horizon: the hit rate and how far it is from a coin's, the distribution and the risk."""
    out = summary.join(risk, "horizon")
    return out.select("horizon", "n", "hit_rate", F.round(F.col("hit_rate") - 50, 1).alias("hit_delta"), "p25_return", "median_return", "p75_return", "max_loss", "max_gain", "sharpe", "pct_loss_gt20", "worst_ticker", "best_ticker")


def risk(returns: DataFrame) -> DataFrame:
    """Share of heavy losses, and the best and worst row; rows without a benchmark are counted and take no part."""
    v = F.col("excess")
    place = F.when(v.isNotNull(), F.struct("excess", "ticker", "signal_date"))
    return returns.groupBy("horizon").agg(F.round(F.avg(F.when(v < -20, 100.0).when(v.isNotNull(), 0.0)), 1).alias("pct_loss_gt20"), F.min(v).alias("worst_outcome"), F.count_if(v.isNull()).alias("n_no_benchmark"), F.max_by("ticker", place).alias("best_ticker"), F.min_by("ticker", place).alias("worst_ticker"))


def rolling_hit_rate(returns: DataFrame, window: int = 90, step: int = 14, least: int = 5) -> DataFrame:
    """Every ``step`` days from the first to the last entry, the hit rate of the ``window`` days before.

    Entries are counted per day first, so a window is a sum over at most ``window`` days.
    """
    daily = returns.where("excess IS NOT NULL").groupBy("horizon", "start_date").agg(F.count("*").alias("n"), F.count_if(F.col("excess") > 0).alias("hits"))
    span = daily.groupBy("horizon").agg(F.min("start_date").alias("lo"), F.max("start_date").alias("hi"))
    points = span.select("horizon", F.explode(F.sequence("lo", "hi", F.make_dt_interval(F.lit(step)))).alias("date"))
    # a checkpoint carries no trades; running sums over days give each window as a difference
    both = daily.select("horizon", F.col("start_date").alias("date"), "n", "hits", F.lit(False).alias("check")).unionByName(points.select("horizon", "date", F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(True).alias("check")))
    w = Window.partitionBy("horizon").orderBy(F.unix_date("date")).rangeBetween(-window, 0)
    out = both.withColumn("trades", F.sum("n").over(w)).withColumn("won", F.sum("hits").over(w)).where("check").where(F.col("trades") >= least)
    return out.select("horizon", "date", F.round(F.col("won") * 100.0 / F.col("trades"), 1).alias("hit_rate"), F.col("trades").alias("n"))


def longest_losing_streak(returns: DataFrame) -> DataFrame:
    """Most losses (excess of 0 or less) in a row, by entry date, signal date and ticker.

    Runs are counted within each (horizon, entry date); of a day only its number of rows, its longest
    run and the runs at its two ends go on, so the window over a horizon sees days, not trades.
    """
    day = ["horizon", "start_date"]
    rows = returns.where("excess IS NOT NULL").withColumn("_won", (F.col("excess") > 0).cast("int"))
    w = Window.partitionBy(*day).orderBy("signal_date", "ticker")
    island = rows.withColumn("_island", F.sum("_won").over(w))
    runs = island.groupBy(*day, "_island").agg(F.sum(1 - F.col("_won")).alias("run"))
    days = runs.groupBy(*day).agg(F.max("run").alias("best"), F.min_by("run", "_island").alias("head"), F.max_by("run", "_island").alias("tail"), F.min("_island").alias("lo"), F.max("_island").alias("wins"))
    # a day without a win is all one run and carries the run before it on
    days = days.withColumn("head", F.when(F.col("lo") == 0, F.col("head")).otherwise(0))
    order = Window.partitionBy("horizon").orderBy("start_date")
    block = F.sum(F.when(F.col("wins") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("_block", F.coalesce(block, F.lit(0)))  # days up to and with the next one that has a win
    joined = days.groupBy("horizon", "_block").agg(F.sum(F.when(F.col("wins") == 0, F.col("best")).otherwise(F.col("head"))).alias("across"), F.max("best").alias("best"), F.max(F.when(F.col("wins") > 0, F.col("tail"))).alias("tail"))
    before = F.coalesce(F.lag("tail").over(Window.partitionBy("horizon").orderBy("_block")), F.lit(0))
    joined = joined.withColumn("across", F.col("across") + before)
    return joined.groupBy("horizon").agg(F.greatest(F.max("across"), F.max("best"), F.max("tail")).alias("max_consecutive_losses"))


def coverage(signals: DataFrame, as_of: Column, shortest: int = 30, lag: int = 3) -> DataFrame:
    return signals.agg(F.min("signal_date").alias("first_date"), F.max("signal_date").alias("last_date"), F.count_if(F.col("signal_date") <= F.date_sub(as_of, shortest + lag)).alias("n_complete"), F.date_add(F.min("signal_date"), shortest + lag).alias("first_result"))
