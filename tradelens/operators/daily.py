"""The daily run: what has been filed since the last one is scored once, merged, and its alerts go out once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators import clusters, dedup, feeds, scoring
from tradelens.operators.merged import MergedTable

#: Columns of a stored signal.
SIGNAL = ["ticker", "signal_date", "as_of", "score", "signal_type", "cluster_flag", "tight_cluster", "executive_cluster", "insider_count", "n_purchases", "min_lag", "cap_tier", "breakdown"]


def month(column: str):
    return F.date_format(column, "yyyy-MM")


class DailyStore:
    """Stored signals, the keys of scored work items, and the outbox; each a table of monthly partitions."""

    def __init__(self, spark: SparkSession, path: str, signal: T.StructType) -> None:
        text, day = T.StringType(), T.DateType()
        of = lambda *fields: T.StructType([*fields, T.StructField("month", text)])
        self.signals = MergedTable(spark, f"{path}/signals", of(*[signal[c] for c in SIGNAL], T.StructField("alerted", T.BooleanType())), "month")
        self.scored = MergedTable(spark, f"{path}/scored", of(T.StructField("ticker", text), T.StructField("as_of", day)), "month")
        self.outbox = MergedTable(spark, f"{path}/outbox", of(T.StructField("ticker", text), T.StructField("signal_date", day), T.StructField("score", T.IntegerType()), T.StructField("run_date", day)), "month")

    def mark(self) -> date | None:
        """The last day that has scored work items."""
        return dedup.high_water_mark(self.scored.read(), "as_of").first()[0]


def first_day(mark: date | None, today: date, back: int = 7) -> date:
    """Where a run starts: at the mark, but never more than ``back`` days ago."""
    oldest = today - timedelta(days=back)
    return oldest if mark is None else max(mark, oldest)


def run(store: DailyStore, transactions: DataFrame, score: Callable[[DataFrame, DataFrame, date], DataFrame], today: date, back: int = 7, force: bool = False) -> date:
    """Score the work items filed since the last run, day by day, each with what was filed by that day.

    Items that are scored already are left out before anything is computed for them; ``force`` takes all
    items of the last ``back`` days again. ``score(transactions, items, day)`` gives a signal for each item.
    So a run that was missed is made up for by the next one, with the same result. The merge by (ticker,
    signal_date) overwrites all but the alerted flag: an alert that has been sent is not sent again. Each
    step leaves its table in a state from which the whole run can be repeated. Returns the first day.
    """
    start = today - timedelta(days=back) if force else first_day(store.mark(), today, back)
    for k in range((today - start).days + 1):
        day = start + timedelta(days=k)
        known = transactions.where(F.col("filed_date") <= F.lit(day))
        items = clusters.work_items(known.where(F.col("filed_date") == F.lit(day))).withColumn("month", month("as_of"))
        if not force:
            items = dedup.not_stored(items, store.scored.read(), ["ticker", "as_of"])
        if items.isEmpty():
            continue
        fresh = scoring.one_per_date(score(known, items.select("ticker", "as_of"), day)).select(*SIGNAL, F.lit(False).alias("alerted"), month("signal_date").alias("month"))
        store.signals.merge(fresh, ["ticker", "signal_date", "month"], [c for c in SIGNAL if c not in ("ticker", "signal_date")])
        deliver(store, day)
        store.scored.insert(items, ["ticker", "as_of", "month"])
    return start


def deliver(store: DailyStore, day: date) -> None:
    """Put cluster alerts of the day that have not been sent into the outbox, then flag them.

    The outbox is written first: after a failure between the two, the next run finds the keys there and only flags them.
    """
    own = store.signals.read().where(F.col("as_of") == F.lit(day))
    new = feeds.outbox(own, store.outbox.read().select("ticker", "signal_date"))
    store.outbox.insert(new.select("ticker", "signal_date", F.col("score").cast("int").alias("score"), F.lit(day).alias("run_date"), "month"), ["ticker", "signal_date", "month"])
    sent = store.outbox.read().where(F.col("run_date") == F.lit(day)).select("ticker", "signal_date", "month", F.lit(True).alias("alerted"))
    store.signals.merge(sent, ["ticker", "signal_date", "month"], ["alerted"])
