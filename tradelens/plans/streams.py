"""Named queries that run as streams: landed in batches out of order, drained batch by batch, some of them twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.operators import clusters, prices, scoring
from tradelens.operators.merged import MergedTable
from tradelens.plans import registry
from tradelens.plans import views as V
from tradelens.plans.oracle import _FOLD, ORACLE, SIGNALS
from tradelens.plans.shared import scratch, stored
from tradelens.plans.views import SQL_EVENTS
from tradelens.streaming import incremental

#: A row of this day closes every window that is still open.
END = "2100-01-01"


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that list and map state need."""
    own = spark.newSession()
    for k, v in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")), ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")):
        own.conf.set(k, v)
    return own


def drained(rows: DataFrame, batch_of, n: int, transform: Callable[[DataFrame], DataFrame], label: str, last: DataFrame | None = None) -> DataFrame:
    """Land ``rows`` in ``n`` batches (``batch_of`` gives each row's) and let the same query take up each of them.

    The query stops after every batch and goes on from its checkpoint with the next. ``last`` is landed
    at the end, to move the watermark past all other rows.
    """
    root, own = scratch(rows.sparkSession, label), stateful(rows.sparkSession)
    held = stored(rows.withColumn("_batch", batch_of), label)
    for k in range(n + (last is not None)):
        part = held.where(F.col("_batch") == k).drop("_batch") if k < n else last
        part.write.parquet(f"{root}/in/batch={k}")
        stream = own.readStream.schema(rows.schema).option("basePath", f"{root}/in").option("recursiveFileLookup", "true").parquet(f"{root}/in")
        out = transform(stream)
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(out.schema).parquet(f"{root}/out")


def late_by(key, days: int):
    """Up to ``days`` days, from the hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(days + 1)).cast("int")


def quantile_batches(date, arrives, rows: DataFrame, n: int):
    """The batch of each row: equal spans of the time in which the rows arrive."""
    lo, hi = rows.agg(F.min(F.unix_date(date)), F.max(F.unix_date(date))).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // n))
    return F.least(F.floor((F.unix_date(arrives) - F.lit(lo or 0)) / width), F.lit(n - 1)).cast("int")


def stream_cooled(spark, d):
    """The cooldown over signals that arrive up to 20 days late, in four batches."""
    rows = registry.all_signals(spark, d).select("ticker", F.col("signal_date").cast("timestamp").alias("ts"), "signal_date", "score", "signal_type")
    arrives = F.date_add("signal_date", late_by("ticker", 20))
    end = spark.createDataFrame([("~", "LOW")], "ticker string, signal_type string").select("ticker", F.lit(END).cast("timestamp").alias("ts"), F.lit(END).cast("date").alias("signal_date"), F.lit(0).alias("score"), "signal_type")
    out = drained(rows, quantile_batches("signal_date", arrives, rows, 4), 4, lambda s: incremental.cooldown_in_order(s, "ts", "21 days"), "stream-cooled", end)
    return out.where("ticker <> '~'")


def _events(spark, d):
    rows = V.event_purchases(V.read(spark, d, "events"))
    arrives = F.date_add("transaction_date", late_by("event_id", 5))
    end = rows.sparkSession.range(1).select(*[(F.lit(END) if f.name in ("ts", "transaction_date", "filed_date") else F.lit("~") if f.name in ("ticker", "insider_name") else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows, quantile_batches("transaction_date", arrives, rows, 3), end


def stream_clusters(spark, d):
    """Clusters of buyers from purchase events that arrive up to five days late, in three batches."""
    rows, batch, end = _events(spark, d)
    out = drained(rows, batch, 3, lambda s: incremental.clusters(s, late="7 days"), "stream-clusters", end)
    return out.where("is_cluster AND ticker <> '~'")


def stream_sessions(spark, d):
    """Buying episodes from the same batches."""
    rows, batch, end = _events(spark, d)
    out = drained(rows, batch, 3, lambda s: incremental.buying_sessions(s, late="7 days"), "stream-sessions", end)
    return out.where("ticker <> '~'")


class Broken(RuntimeError):
    """A failure put in to show what a batch leaves behind."""


def refreshed_signals(spark, d, tx: DataFrame, batch_of, n: int, fail: tuple[int, ...] = ()) -> DataFrame:
    """Signals kept up to date while transactions land in batches, late ones among them.

    A batch is merged into the stored transactions; then the signals of its tickers, from the day of its
    earliest trade on, are made again from what is stored and replace the old ones. Both tables remember
    the batch's number, so a batch that runs again after a failure changes nothing twice, and what it has
    stored is not made again. Lows do not depend on a batch and are made once. ``tx`` is read for each
    batch: a stored table. ``fail``: the batches after whose work the query breaks off before Spark notes
    that they are done.
    """
    root = scratch(spark, "refreshed")
    year = lambda c: F.date_format(c, "yyyy")
    held = tx.withColumn("year", year("transaction_date")).withColumn("_batch", batch_of)
    rows_schema = held.drop("_batch").schema
    transactions = MergedTable(spark, f"{root}/transactions", rows_schema, "year")
    shape = registry.signals_of(spark, d, tx, clusters.work_items(tx)).withColumn("year", year("as_of")).schema
    signals = MergedTable(spark, f"{root}/signals", shape, "year")
    lows = stored(prices.year_lows(V.yearly_bars(spark, d), "cik"), "lows")

    def add(batch: DataFrame, number: int) -> None:
        transactions.insert(batch.select(*rows_schema.fieldNames()), V.TIE, ("landed", number))

    def recompute(changed: DataFrame) -> DataFrame:
        own = transactions.read().join(changed.select("ticker"), "ticker", "left_semi")
        items = clusters.work_items(own).join(changed, "ticker").where("as_of >= since").select("ticker", "as_of")
        return registry.signals_of(spark, d, own, items, lows=lows).withColumn("year", year("as_of"))

    def store(fresh: DataFrame, changed: DataFrame, number: int) -> None:
        if signals.holds(("landed", number)):
            return
        fresh = stored(fresh, "fresh")
        old = signals.read().join(changed, "ticker").where("as_of >= since")
        touched = fresh.select("year").union(old.select("year"))
        replaced = lambda rows: rows.join(changed, "ticker", "left").where("since IS NULL OR as_of < since").drop("since").unionByName(fresh)
        signals.rewrite(touched, replaced, ("landed", number))

    broken = set(fail)

    def after(number: int) -> None:
        if number in broken:
            broken.remove(number)
            raise Broken(number)

    for k in range(n):
        held.where(F.col("_batch") == k).drop("_batch").write.parquet(f"{root}/in/batch={k}")
        for attempt in (1, 2):
            stream = spark.readStream.schema(rows_schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
            query = incremental.recompute_late(stream, add, recompute, store, f"{root}/state", date="transaction_date", after=after)
            try:
                query.awaitTermination()
                break
            except StreamingQueryException:  # the batch runs again from the checkpoint
                if attempt == 2 or k not in fail:
                    raise
    return signals.read()


def stream_signals(spark, d):
    """The signals after three batches of purchases; one line in seven comes a batch late, and the second batch runs twice."""
    tx = registry.all_purchases(spark, d)
    by_time = quantile_batches("filed_date", F.col("filed_date"), tx, 3)
    late = F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
    rows = refreshed_signals(spark, d, tx, F.least(by_time + late, F.lit(2)), 3, fail=(1,))
    return scoring.one_per_date(rows).select("ticker", "signal_date", "as_of", "score", "signal_type", "cluster_flag", "tight_cluster", "executive_cluster", "insider_count", "n_purchases", "min_lag")


NAMES = [stream_cooled, stream_clusters, stream_sessions, stream_signals]

ORACLE_STREAMS = {
    "stream_cooled": SIGNALS.replace("WITH", "WITH RECURSIVE", 1) + _FOLD + " SELECT ticker, signal_date, score, signal_type FROM fold WHERE kept",
    "stream_clusters": ORACLE["event_clusters"],
    "stream_sessions": f"""WITH {SQL_EVENTS},
g AS (SELECT *, CASE WHEN transaction_date - lag(transaction_date) OVER w <= 30 THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY ticker, insider_name ORDER BY transaction_date)),
e AS (SELECT *, sum(s) OVER (PARTITION BY ticker, insider_name ORDER BY transaction_date) AS ep FROM g)
SELECT ticker, insider_name, min(transaction_date) AS first_date, max(transaction_date) AS last_date, count(*) AS n_purchases, CAST(sum(total_value) AS BIGINT) AS value FROM e GROUP BY ticker, insider_name, ep""",
    "stream_signals": ORACLE["signals_raw"],
}
