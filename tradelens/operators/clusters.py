"""Groups of independent buyers in a look-back window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators.dedup import latest_by_key
from tradelens.operators.ranges import in_cells, join_cells, join_in_days  # noqa: F401
from tradelens.schemas import EXECUTIVES, RULES, Rules


def eligible_purchases(tx: DataFrame) -> DataFrame:
    from tradelens.schemas import NO_TICKER

    return tx.where((F.col("transaction_code") == "P") & F.col("ticker").isNotNull() & ~F.col("ticker").isin(NO_TICKER))


def work_items(tx: DataFrame) -> DataFrame:
    """Distinct (ticker, as_of): each day on which a purchase outside a plan was filed."""
    return eligible_purchases(tx).where(~F.col("is_10b51")).select("ticker", F.col("filed_date").alias("as_of")).distinct()


def executive() -> Column:
    return F.coalesce(F.lower("role_category").isin(EXECUTIVES), F.lit(False))


def members(items: DataFrame, tx: DataFrame, order: list, rules: Rules = RULES, point_in_time: bool = True) -> DataFrame:
    """The buyers counted for each item, one row each, after amendments, plans and offerings are taken out.

    Of a buyer the latest purchase in the window counts. Buyers who share price and date with two
    others bought in an offering and do not count.
    """
    own = tx.where((F.col("transaction_code") == "P") & F.col("is_direct") & (F.coalesce("total_value", F.lit(0)) >= rules.cluster_value) & F.col("insider_name").isNotNull())
    own = own.withColumn("_exec", executive())  # once for each purchase, not for each window that it lies in
    # all that follows keeps to one shuffle by (ticker, cell)
    laid = in_cells(own, "ticker", "transaction_date", rules.cluster_days)
    versions = ["ticker", "_cell", "insider_name", "transaction_date", "transaction_code"]
    if point_in_time:  # a version holds from its filing to that of the next better one, so no item needs to rank versions
        better = F.lag("filed_date").over(Window.partitionBy(*versions).orderBy(F.desc("filed_date"), *order))
        laid = laid.where("filed_date IS NOT NULL").withColumn("_until", better).where(F.coalesce(F.col("filed_date") < F.col("_until"), F.lit(True)))
    else:
        laid = latest_by_key(laid, versions, [F.desc("filed_date"), *order])
    near = join_cells(items, laid.where(~F.col("is_10b51")), "ticker", "as_of", "transaction_date", rules.cluster_days)
    if point_in_time:
        near = near.where((F.col("filed_date") <= F.col("as_of")) & F.coalesce(F.col("as_of") < F.col("_until"), F.lit(True))).drop("_until")
    buyers = latest_by_key(near, ["ticker", "_cell", "as_of", "insider_name"], [F.desc("transaction_date"), *order])
    same = Window.partitionBy("ticker", "_cell", "as_of", "price_per_share", "transaction_date")
    return buyers.withColumn("_same", F.count("*").over(same)).where(F.col("_same") < rules.cluster_buyers).drop("_same")


def cluster_windows(found: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Per (ticker, as_of): insider_count, is_cluster, executive_cluster, tight_cluster."""
    keys = ["ticker", "as_of", *[c for c in found.columns if c == "_cell"]]
    w = Window.partitionBy(*keys).orderBy("transaction_date", "insider_name")
    span = F.date_diff(F.lead("transaction_date", rules.cluster_buyers - 1).over(w), "transaction_date")
    marked = found.withColumn("_tight", F.coalesce(span <= rules.tight_days, F.lit(False)))
    out = marked.groupBy(*keys).agg(F.count("*").alias("insider_count"), F.bool_or("_exec" if "_exec" in found.columns else executive()).alias("_exec"), F.bool_or("_tight").alias("_tight"))
    is_cluster = F.col("insider_count") >= rules.cluster_buyers
    return out.select("ticker", "as_of", "insider_count", is_cluster.alias("is_cluster"), (is_cluster & F.col("_exec")).alias("executive_cluster"), (is_cluster & F.col("_tight")).alias("tight_cluster"))
