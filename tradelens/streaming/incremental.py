"""Structured Streaming twins of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.schemas import EXECUTIVES, RULES, TYPE_RANK, Rules

#: 1970-01-01 as an ordinal.
EPOCH = date(1970, 1, 1).toordinal()


def once_per_key(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sliding_buyers(stream: DataFrame, time: str = "ts", ticker: str = "ticker", actor: str = "insider_name", late: str = "7 days", days: int = 15) -> DataFrame:
    """Distinct buyers per ticker in each window of ``days`` days that slides by one day."""
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = held.groupBy(F.window(time, f"{days} days", "1 day"), ticker).agg(F.size(F.collect_set(actor)).alias("n_buyers"), F.count("*").alias("n_purchases"))
    return out.select(ticker, F.to_date("window.start").alias("window_start"), F.to_date(F.date_sub(F.to_date("window.end"), 1)).alias("window_end"), "n_buyers", "n_purchases")


def buying_sessions(stream: DataFrame, time: str = "transaction_date", actor: tuple[str, ...] = ("ticker", "insider_name"), gap: int = 30, late: str = "7 days", value: str = "total_value") -> DataFrame:
    """Runs of purchases by one actor with at most ``gap`` days between neighbours: sessions that merge as rows come in.

    A session is emitted once the watermark has passed its end and the gap. The twin of ``history.buying_episodes``.
    """
    day = stream.withColumn("_day", F.col(time).cast("date").cast("timestamp"))
    held = day.withWatermark("_day", late) if stream.isStreaming else day
    # whole days: a neighbour is in the session up to the end of the gap's last day
    out = held.groupBy(F.session_window("_day", f"{gap * 24 + 1} hours").alias("session"), *actor).agg(F.min(time).cast("date").alias("first_date"), F.max(time).cast("date").alias("last_date"), F.count("*").alias("n_purchases"), F.sum(value).alias("value"))
    return out.drop("session")


def clusters(stream: DataFrame, time: str = "ts", late: str = "7 days", rules: Rules = RULES) -> DataFrame:
    """Groups of independent buyers per (ticker, as_of), as ``operators.clusters`` finds them, from a stream in append mode.

    Every day is the end of a window of ``cluster_days`` before it. Three aggregations with state follow
    one another under one watermark: each buyer's latest purchase of the window; how many buyers share its
    price and date (three or more bought in an offering and do not count); buyers per day. The last one
    gathers at most ``cluster_days`` + 1 counts. A window counts if something was filed on its last day.
    """
    days = rules.cluster_days + 1
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    own = F.col("is_direct") & (F.coalesce("total_value", F.lit(0)) >= rules.cluster_value) & F.col("insider_name").isNotNull()
    rows = held.select(F.window(time, f"{days} days", "1 day").alias("window"), "*")
    as_of = F.date_sub(F.to_date("window.end"), 1)
    filed = F.to_date(time) == as_of
    purchase = F.struct("transaction_date", "event_id", "price_per_share", "role_category")
    buyers = rows.groupBy("window", "ticker", "insider_name").agg(F.max(F.when(own, purchase)).alias("p"), F.bool_or(filed).alias("filed"))
    offers = buyers.groupBy("window", "ticker", F.col("p.price_per_share").alias("price"), F.col("p.transaction_date").alias("day")).agg(F.count("p").alias("n"), F.bool_or("filed").alias("filed"), F.bool_or(F.coalesce(F.lower("p.role_category").isin(EXECUTIVES), F.lit(False))).alias("exec"))
    counts = F.col("n") < rules.cluster_buyers
    per_day = offers.groupBy("window", "ticker", "day").agg(F.sum(F.when(counts, F.col("n")).otherwise(0)).alias("n"), F.bool_or("filed").alias("filed"), F.bool_or(F.col("exec") & counts).alias("exec"))
    found = per_day.groupBy("window", "ticker").agg(F.sum("n").alias("insider_count"), F.bool_or("filed").alias("filed"), F.bool_or("exec").alias("_exec"), F.collect_list(F.when(F.col("n") > 0, F.struct("day", "n"))).alias("_days"))
    near = lambda x: F.aggregate(F.filter("_days", lambda y: (y.day >= x.day) & (y.day <= F.date_add(x.day, rules.tight_days))), F.lit(0).cast("long"), lambda a, y: a + y.n)
    is_cluster = F.col("insider_count") >= rules.cluster_buyers
    tight = F.exists("_days", lambda x: near(x) >= rules.cluster_buyers)
    return found.where("filed").select("ticker", as_of.alias("as_of"), "insider_count", is_cluster.alias("is_cluster"), (is_cluster & F.col("_exec")).alias("executive_cluster"), (is_cluster & tight).alias("tight_cluster"))


def cooldown(stream: DataFrame, rules: Rules = RULES, ttl_days: int | None = None) -> DataFrame:
    """Greedy cooldown with state: per ticker the last kept signal.

    Needs (ticker, signal_date, score, signal_type). Within a micro-batch rows are taken by date, score
    and rank, as the batch fold takes them; from one micro-batch to the next they must come in order
    (``cooldown_in_order`` waits until they are). With ``ttl_days`` a ticker's state, three numbers, goes so
    long after its last kept signal: processing time, so longer than the cooldown and any delay of the
    input. Such a query runs batches for ever, so one that drains its input (availableNow) goes without.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Keep(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "day int, score int, rank int", *([] if ttl_days is None else [ttl_days * 86_400_000]))

        def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
            import pandas as pd

            frame = pd.concat(list(rows))
            frame = frame.assign(_rank=frame["signal_type"].map(TYPE_RANK).fillna(0)).sort_values(["signal_date", "score", "_rank"])
            last = self.last.get() if self.last.exists() else None
            kept = []
            for r in frame.itertuples(index=False):
                day = (pd.Timestamp(r.signal_date) - pd.Timestamp(0)).days
                rank = TYPE_RANK.get(r.signal_type, 0)
                if last and abs(day - last[0]) < rules.cooldown_days and r.score < last[1] + rules.cooldown_jump and rank <= last[2]:
                    continue
                last = (int(day), int(r.score), int(rank))
                kept.append(r)
            if last:
                self.last.update(last)
            yield pd.DataFrame([tuple(r) for r in kept], columns=frame.columns)[["ticker", "signal_date", "score", "signal_type"]]

        def close(self) -> None:
            pass

    own = stream.select("ticker", "signal_date", F.col("score").cast("int"), "signal_type")
    return own.groupBy("ticker").transformWithStateInPandas(Keep(), "ticker string, signal_date date, score int, signal_type string", "append", "none" if ttl_days is None else "processingTime")


def cooldown_in_order(stream: DataFrame, time: str = "ts", late: str = "7 days", rules: Rules = RULES) -> DataFrame:
    """Greedy cooldown over signals that arrive in any order, up to ``late`` behind the newest.

    A row waits in its ticker's list until the watermark has passed its day: by then all rows of that day
    and earlier ones are there, whatever batches brought them. A ticker has one event-time timer, for the
    earliest day that waits; it takes all days that the watermark has passed, by day, score and rank, as the
    batch fold does, so a list is read once for each batch and not for each day. State is what waits, the
    timer's day, and three numbers.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Wait(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "day int, score int, signal_type string")
            self.timer = handle.getValueState("timer", "day int")
            self.last = handle.getValueState("last", "day int, score int, rank int")

        def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
            import pandas as pd

            first = None
            for frame in rows:
                day = (pd.to_datetime(frame["signal_date"]) - pd.Timestamp(0)).dt.days.tolist()
                self.waiting.appendList(list(zip(day, frame["score"].tolist(), frame["signal_type"].tolist())))
                first = min(day) if first is None else min(first, *day)
            set_to = self.timer.get()[0] if self.timer.exists() else None
            if first is not None and (set_to is None or first < set_to):
                if set_to is not None:
                    self.handle.deleteTimer(set_to * 86_400_000)
                self.handle.registerTimer(first * 86_400_000)
                self.timer.update((first,))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            import pandas as pd

            due = timerValues.getCurrentWatermarkInMs() // 86_400_000
            held = [tuple(r) for r in self.waiting.get()]
            ready = sorted((r for r in held if r[0] <= due), key=lambda r: (r[0], r[1], TYPE_RANK.get(r[2], 0)))
            rest = [r for r in held if r[0] > due]
            if rest:
                self.waiting.put(rest)
                first = min(r[0] for r in rest)
                self.handle.registerTimer(first * 86_400_000)
                self.timer.update((first,))
            else:
                self.waiting.clear()
                self.timer.clear()
            last = self.last.get() if self.last.exists() else None
            kept = []
            for day, score, kind in ready:
                rank = TYPE_RANK.get(kind, 0)
                if last and abs(day - last[0]) < rules.cooldown_days and score < last[1] + rules.cooldown_jump and rank <= last[2]:
                    continue
                last = (day, score, rank)
                kept.append((*key, date.fromordinal(EPOCH + day), score, kind))
            if kept:
                self.last.update(last)
                yield pd.DataFrame(kept, columns=["ticker", "signal_date", "score", "signal_type"])

        def close(self) -> None:
            pass

    own = stream.withWatermark(time, late).select("ticker", time, "signal_date", F.col("score").cast("int"), "signal_type")
    return own.groupBy("ticker").transformWithStateInPandas(Wait(), "ticker string, signal_date date, score int, signal_type string", "append", "eventTime")


def enriched(stream: DataFrame, companies: DataFrame, key: str = "ticker") -> DataFrame:
    """Stream rows with the columns of a static table (one row per key); unknown keys stay, with nulls."""
    return stream.join(companies.dropDuplicates([key]), key, "left")


def recompute_late(stream: DataFrame, add, recompute, store, checkpoint: str, key: str = "ticker", date: str = "filed_date", back: int = 0, after=None):
    """For each micro-batch recompute what its rows, late ones too, may have changed, and replace that in the store.

    ``add(batch, number)`` puts the rows into the stored input. ``recompute(changed)`` gets (key, since), where
    since is ``back`` days before the key's earliest date in the batch, and returns fresh rows;
    ``store(fresh, changed, number)`` replaces what is stored for them. All three must be safe to repeat with
    one number: a batch that fails runs again with the same rows and number. ``after(number)`` is called last.
    """

    def apply(batch: DataFrame, number: int) -> None:
        changed = batch.groupBy(key).agg(F.date_sub(F.min(date), back).alias("since")).persist()
        changed.count()  # its size is known to the joins that follow
        try:
            add(batch, number)
            store(recompute(changed), changed, number)
        finally:
            changed.unpersist()
        if after:
            after(number)

    return upsert_batches(stream, apply, checkpoint)


def upsert_batches(stream: DataFrame, apply, checkpoint: str):
    """Run ``apply(batch, id)`` for each micro-batch: the place for upserts, outboxes and late recomputation."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
