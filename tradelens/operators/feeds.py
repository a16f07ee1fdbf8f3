"""Report tables made from signals, returns and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.columns import conviction, routine_label, sample_label, type_rank
from tradelens.operators.dedup import latest_by_key, top_per_key


def one_per_ticker(companies: DataFrame) -> DataFrame:
    """Tickers are not unique: the latest company of each."""
    return latest_by_key(companies, ["ticker"], [F.desc_nulls_last("updated_at"), F.asc("cik")])


def filtered(signals: DataFrame, since=None, least_score: int | None = None, types: list[str] | None = None, tiers: list[str] | None = None) -> DataFrame:
    """Feed filters; an empty list is no filter and a null tier counts as unknown."""
    out = signals
    if since is not None:
        out = out.where(F.col("signal_date") >= since)
    if least_score is not None:
        out = out.where(F.col("score") >= least_score)
    if types:
        out = out.where(F.col("signal_type").isin(types))
    if tiers:
        out = out.where(F.coalesce("cap_tier", F.lit("unknown")).isin(tiers))
    return out


def feed(signals: DataFrame) -> DataFrame:
    """Add conviction and the two sort keys: type rank, and quality among clusters."""
    tight, executive = F.coalesce("tight_cluster", F.lit(False)), F.coalesce("executive_cluster", F.lit(False))
    quality = F.when(F.col("signal_type") != "CLUSTER_BUY", 9).when(tight & executive, 0).when(tight, 1).when(executive, 2).otherwise(3)
    return signals.withColumn("conviction", conviction(F.col("signal_type"), F.col("score"), tight, executive)).withColumn("type_rank", type_rank(F.col("signal_type"))).withColumn("quality", quality)


FEED_ORDER = [F.desc, "type_rank"], [F.asc, "quality"], [F.desc, "score"], [F.desc, "signal_date"], [F.asc, "ticker"]


def feed_order() -> list[Column]:
    return [f(c) for f, c in FEED_ORDER]


def top_picks(ranked: DataFrame, k: int = 3) -> DataFrame:
    """The best k clusters, or the best k BUY signals where there is no cluster. A top-k, not a global sort."""
    strong = ranked.where(F.col("signal_type").isin("CLUSTER_BUY", "BUY"))
    best = strong.agg(F.max("type_rank").alias("type_rank"))
    return strong.join(F.broadcast(best), "type_rank").orderBy(*feed_order()).limit(k)  # best is one row


def headline(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("n"), F.count_if(F.col("signal_type") == "CLUSTER_BUY").alias("clusters"), F.count_if(F.col("signal_type") == "BUY").alias("buys"), F.round(F.avg("score"), 4).alias("avg_score"))


def positions(signals: DataFrame, rollup: DataFrame, prices: DataFrame, as_of: Column, hold: int = 90) -> DataFrame:
    """Entry price (value over shares of the insiders), return at the latest price, days in and left, status."""
    entry = rollup.groupBy("ticker", "as_of").agg((F.sum("total_value") / F.sum("shares_bought")).cast("double").alias("entry_price"))
    out = signals.join(entry, ["ticker", "as_of"]).join(prices, "ticker", "left")
    days = F.date_diff(as_of, "signal_date")
    ret = F.when(F.col("entry_price") > 0, (F.col("current_price") - F.col("entry_price")) / F.col("entry_price") * 100)
    return out.select("ticker", "signal_date", "signal_type", F.round("entry_price", 4).alias("entry_price"), F.round(ret, 4).alias("return_pct"), days.alias("days_in"), F.greatest(F.lit(hold) - days, F.lit(0)).alias("days_left"), F.when(days >= hold, "closed").otherwise("open").alias("status"))


def monthly_excess(returns: DataFrame) -> DataFrame:
    return returns.where("excess IS NOT NULL").groupBy("horizon", F.to_date(F.trunc("start_date", "MM")).alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("excess"), 4).alias("avg_excess"))


def strata_labels(strata: DataFrame) -> DataFrame:
    return strata.withColumn("sample", sample_label(F.col("n")))


def entity_history(tx: DataFrame, order: list[Column], k: int = 100) -> DataFrame:
    """Latest k transactions of each ticker, with the routine label."""
    out = top_per_key(tx, ["ticker"], [F.desc("transaction_date"), *order], k)
    return out.withColumn("routine_label", routine_label(F.col("routine")))


def purchase_points(tx: DataFrame) -> DataFrame:
    """Chart points: bad numbers become null, missing shares 0, and rows without a price go."""
    price = F.col("price_per_share").try_cast("double")
    return tx.where(price.isNotNull()).withColumn("price", price).withColumn("size", F.coalesce(F.col("shares").try_cast("double"), F.lit(0.0)))


def unsent(signals: DataFrame, least: int = 60) -> DataFrame:
    """Signals not sent yet that score or cluster."""
    return signals.where(~F.coalesce("alerted", F.lit(False)) & ((F.col("score") >= least) | F.col("cluster_flag")))


def alert_queue(signals: DataFrame, least: int = 60) -> DataFrame:
    """The unsent signals, best first."""
    return unsent(signals, least).orderBy(F.desc("score"), F.desc("signal_date"), "ticker")


def exists(df: DataFrame, name: str = "found") -> DataFrame:
    """One row: is there any? Tasks stop at their first row."""
    return df.select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias(name))


def latest_signals(signals: DataFrame, k: int = 20) -> DataFrame:
    """The latest ``k`` signals of each ticker."""
    return top_per_key(signals, ["ticker"], [F.desc("signal_date")], k)


def outbox(signals: DataFrame, sent: DataFrame) -> DataFrame:
    """New cluster alerts: not flagged, and not in the table of sent keys."""
    return signals.where((F.col("signal_type") == "CLUSTER_BUY") & ~F.coalesce("alerted", F.lit(False))).join(sent, ["ticker", "signal_date"], "left_anti")


def daily_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("alerted", F.lit(False))).alias("alerted"))


def facets(df: DataFrame, most: int = 12) -> DataFrame:
    """Per column: its distinct values, counted up to one more than ``most``, and whether a filter lists them or searches text.

    Exact: values are made distinct by (column, value), and of each column only so many go on as decide.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    few = values.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("_n") <= most + 1)
    counts = few.groupBy("column").agg(F.max("_n").cast("long").alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    out = every.join(counts, "column", "left").na.fill(0, ["n_distinct"])
    return out.withColumn("filter", F.when(F.col("n_distinct") <= most, "members").otherwise("contains"))


def contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.coalesce(F.lower(F.col(column).cast("string")).contains(text.lower()), F.lit(False)))


def cap_rank_slice(listing: DataFrame, lo: int = 1001, hi: int = 3000) -> DataFrame:
    """Listed symbols from rank lo to hi by market value.

    The ranks come from counts: the values are range-partitioned by sorting, so no single task holds
    the listing; only those up to ``hi`` are ranked in one place.
    """
    top = listing.orderBy(F.desc_nulls_last("market_cap"), "symbol").limit(hi)
    w = Window.orderBy(F.desc_nulls_last("market_cap"), "symbol")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") >= lo)
