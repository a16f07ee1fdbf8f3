"""A stream that has ended equals its batch twin."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tradelens.operators import clusters, cooldown, history
from tradelens.operators.merged import MergedTable
from tradelens.plans import registry, streams
from tradelens.plans import views as V
from tradelens.streaming import incremental


def drained(spark, stream, tmp_path, mode="append"):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_cooldown_stream_is_the_batch_fold(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    rows = [("T" + str(k % 3), day + dt.timedelta(days=(k * 5) % 60), 50 + (k * 7) % 30, ["LOW", "WATCH", "BUY", "CLUSTER_BUY"][k % 4]) for k in range(60)]
    df = spark.createDataFrame(rows, "ticker string, signal_date date, score int, signal_type string").dropDuplicates(["ticker", "signal_date"]).cache()
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drained(spark, incremental.cooldown(stream), tmp_path)
    want = cooldown.greedy(df).select("ticker", "signal_date", "score", "signal_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_of_buyers_is_its_batch_twin(spark, tmp_path):
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(hours=9 * k), "T" + str(k % 2), "I" + str(k % 5)) for k in range(50)]
    schema = "ts timestamp, ticker string, insider_name string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    spark.createDataFrame([(start + dt.timedelta(days=400), "Z", "z")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(spark, incremental.sliding_buyers(stream), tmp_path).where("ticker <> 'Z'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, incremental.sliding_buyers(df).collect()))


def test_event_stream_query(spark, small):
    got = registry.stream_dedup(spark, small)
    assert got.count() == spark.read.parquet(f"{small}/events.parquet").select("event_id").distinct().count()
    assert got.agg(F.countDistinct("event_id")).first()[0] == got.count()


SIGNALS = "ticker string, signal_date date, score int, signal_type string"


def test_cooldown_waits_for_the_watermark(spark):
    """Rows come up to nine days late, over batches, in no order: the result is that of the batch fold."""
    day = dt.date(2020, 1, 1)
    rows = [("T" + str(k % 2), day + dt.timedelta(days=(k * 7) % 90), 40 + (k * 13) % 45, ["LOW", "WATCH", "BUY", "CLUSTER_BUY"][k % 4]) for k in range(120)]
    df = spark.createDataFrame(rows, SIGNALS).dropDuplicates(["ticker", "signal_date"]).withColumn("ts", F.col("signal_date").cast("timestamp"))
    arrives = F.date_add("signal_date", F.pmod(F.xxhash64("ticker", "signal_date"), F.lit(10)).cast("int"))
    end = spark.createDataFrame([("~", dt.date(2100, 1, 1), 0, "LOW")], SIGNALS).withColumn("ts", F.col("signal_date").cast("timestamp"))
    got = streams.drained(df, streams.quantile_batches("signal_date", arrives, df, 3), 3, lambda s: incremental.cooldown_in_order(s, "ts", "10 days"), "cooled", end).where("ticker <> '~'")
    want = cooldown.greedy(df.drop("ts")).select("ticker", "signal_date", "score", "signal_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = streams.drained(df, streams.quantile_batches("signal_date", arrives, df, 3), 3, incremental.cooldown, "cooled")
    assert sorted(map(tuple, plain.collect())) != sorted(map(tuple, want.collect()))  # without waiting, order over batches matters


def test_sessions_and_clusters_are_their_batch_twins(spark, small):
    tx = V.event_purchases(V.read(spark, small, "events"))
    got = incremental.buying_sessions(tx).select("ticker", "insider_name", "first_date", "last_date", "n_purchases", "value")
    want = history.buying_episodes(tx, ["ticker", "insider_name"]).select("ticker", "insider_name", "first_date", "last_date", "n_purchases", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = incremental.clusters(tx).where("insider_count > 0")
    want = clusters.cluster_windows(clusters.members(clusters.work_items(tx), tx, [F.desc("event_id")]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_session_gap_is_closed(spark):
    day = dt.date(2020, 1, 1)
    rows = [("A", "x", day, 1), ("A", "x", day + dt.timedelta(30), 1), ("A", "x", day + dt.timedelta(61), 1), ("A", None, day, 1)]
    got = incremental.buying_sessions(spark.createDataFrame(rows, "ticker string, insider_name string, transaction_date date, total_value int"))
    assert sorted((str(r.insider_name), r.first_date.day, r.n_purchases) for r in got.collect()) == [("None", 1, 1), ("x", 1, 2), ("x", 2, 1)]


@pytest.mark.parametrize("where", ["add", "store", "after"])
def test_a_repeated_batch_changes_nothing_twice(spark, tmp_path, where):
    """Counts per ticker, recomputed from stored rows; the second batch, a late one, breaks off once and runs again."""
    schema = spark.createDataFrame([], "k int, ticker string, filed_date date").schema
    counts = spark.createDataFrame([], "ticker string, since date, n long").schema
    rows, found = MergedTable(spark, f"file://{tmp_path}/rows", schema, "ticker"), MergedTable(spark, f"file://{tmp_path}/found", counts, "ticker")
    broken, seen = {"add", "store", "after"} - {where}, []

    def fail(place, number):
        seen.append((place, number))
        if number == 1 and place not in broken:
            broken.add(place)
            raise RuntimeError(place)

    def add(batch, number):
        rows.insert(batch, ["k"], ("s", number))
        fail("add", number)

    def recompute(changed):
        return rows.read().join(changed, "ticker").where("filed_date >= since").groupBy("ticker", "since").agg(F.count("*").alias("n"))

    def store(fresh, changed, number):
        keep = lambda old: old.join(changed.select("ticker"), "ticker", "left_anti").unionByName(fresh)
        found.rewrite(changed.select("ticker"), keep, ("s", number))
        fail("store", number)

    day = dt.date(2020, 1, 10)
    batches = [[(1, "A", day), (2, "B", day)], [(3, "A", day - dt.timedelta(3)), (2, "B", day)], [(4, "C", day)]]
    failures = 0
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
        for _ in range(2):
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            try:
                incremental.recompute_late(stream, add, recompute, store, f"{tmp_path}/state", back=1, after=lambda n: fail("after", n)).awaitTermination()
                break
            except StreamingQueryException:
                failures += 1
    assert failures == 1 and seen.count(("add", 1)) == 2
    assert sorted((r.ticker, r.since.day, r.n) for r in found.read().collect()) == [("A", 6, 2), ("B", 9, 1), ("C", 9, 1)]
    assert rows.read().count() == 4 and rows.version() == 3 and found.version() == 3


def test_late_lines_and_a_repeated_batch_give_the_same_signals(spark, small):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(streams.stream_signals(spark, small)) == key(registry.signals_raw(spark, small))


def test_a_repeated_batch_makes_neither_signals_nor_lows_again(spark, small, monkeypatch):
    made, kept = [], streams.stored
    monkeypatch.setattr(streams, "stored", lambda df, label: made.append(label) or kept(df, label))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(streams.stream_signals(spark, small)) == key(registry.signals_raw(spark, small))
    assert made == ["lows", "fresh", "fresh", "fresh"]  # the second of three batches runs twice


def test_a_ticker_has_one_timer_and_its_list_is_read_once_a_batch():
    import pandas as pd

    class State:
        def __init__(self):
            self.value, self.reads = None, 0

        exists = lambda self: self.value is not None
        update = put = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)
        appendList = lambda self, v: setattr(self, "value", (self.value or []) + v)

        def get(self):
            self.reads += 1
            return self.value if self.value is not None else []

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, set()

        def getValueState(self, name, *_):
            return self.states.setdefault(name, State())

        getListState = getValueState
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    class Stream:  # takes the processor out of the query
        withWatermark = select = groupBy = lambda self, *a: self
        transformWithStateInPandas = lambda self, processor, *a: processor

    class At:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    processor, handle = incremental.cooldown_in_order(Stream()), Handle()
    processor.init(handle)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    ms = lambda k: (day(k) - dt.date(1970, 1, 1)).days * 86_400_000
    frame = lambda days: pd.DataFrame({"ticker": "A", "signal_date": [day(k) for k in days], "score": 50, "signal_type": "BUY"})
    list(processor.handleInputRows(("A",), iter([frame(range(100, 0, -1))]), None))
    list(processor.handleInputRows(("A",), iter([frame([0, 120])]), None))
    assert handle.timers == {ms(0)}
    handle.timers.clear()
    out = pd.concat(list(processor.handleExpiredTimer(("A",), At(ms(60)), At(ms(0)))))
    kept = [(d - day(0)).days for d in out["signal_date"]]
    gap = incremental.RULES.cooldown_days
    assert kept == list(range(0, 61, gap)) and handle.timers == {ms(61)} and handle.states["waiting"].reads == 1
