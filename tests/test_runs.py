"""Stored runs, the daily run, alert text, evidence and evolved files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators import clusters, daily, evidence, feeds, run_store, tables
from tradelens.plans import registry
from tradelens.plans import views as V

DAY = dt.date(1997, 6, 26)


def run_frame(spark, day, n):
    return spark.createDataFrame([(dt.date.fromisoformat(day), 60, h, n, '{"risk": {"max_consecutive_losses": 4}}') for h in (30, 60)], "run_date date, threshold int, horizon_days int, n_trades long, metrics string")


def test_latest_run_prunes_partitions_while_it_runs(spark, tmp_path):
    path = f"file://{tmp_path}"
    detail = spark.createDataFrame([("A", 1.0)], "ticker string, excess double")
    for day, n in (("2020-01-01", 1), ("2020-02-01", 2), ("2020-02-01", 3)):
        run_store.save(run_frame(spark, day, n), detail, path)
    every = run_store.runs(spark, path)
    assert every.count() == 4 and spark.read.parquet(f"{path}/detail").count() == 2
    last = run_store.latest(every)
    assert [(str(r.run_date), r.horizon_days, r.n_trades, r.metrics.risk.max_consecutive_losses) for r in last.orderBy("horizon_days").collect()] == [("2020-02-01", 30, 3, 4), ("2020-02-01", 60, 3, 4)]
    plan = last._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "ubquery" in line]
    assert filters and "run_date" in filters[0]
    assert [r.n_trades for r in run_store.recent(every, 3).collect()] == [3, 3, 1]


@pytest.fixture(scope="module")
def filed(spark, small):
    return V.transactions(spark, small).where("filed_date <= DATE '1997-06-28'").cache()


def test_two_daily_runs_are_one_run_over_both(spark, small, filed, tmp_path):
    calls = []

    def score(known, items, day):
        calls.append(day)
        return registry.signals_of(spark, small, known, items)

    shape = score(filed, clusters.work_items(filed), None).schema
    two, one = daily.DailyStore(spark, f"file://{tmp_path}/two", shape), daily.DailyStore(spark, f"file://{tmp_path}/one", shape)
    day1, day2 = DAY, DAY + dt.timedelta(1)
    assert daily.run(two, filed, score, day1, back=2) == day1 - dt.timedelta(2)
    calls.clear()
    mark = two.mark()
    assert mark <= day1 and daily.run(two, filed, score, day2, back=3) == mark
    assert all(day > mark for day in calls)  # the mark's items are stored
    daily.run(one, filed, score, day2, back=3)
    rows = lambda store: sorted(map(repr, store.signals.read().collect()))
    assert rows(two) == rows(one) and rows(two)
    assert sorted(map(tuple, two.outbox.read().drop("run_date").collect())) == sorted(map(tuple, one.outbox.read().drop("run_date").collect()))

    before = rows(two)
    calls.clear()
    daily.run(two, filed, score, day2, back=3)  # nothing is new
    assert not calls and rows(two) == before
    daily.run(two, filed, score, day2, back=1, force=True)
    assert calls and rows(two) == before


def test_an_alert_goes_out_once(spark, tmp_path):
    shape = T.StructType([T.StructField(n, t) for n, t in zip(daily.SIGNAL, [T.StringType(), T.DateType(), T.DateType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.BooleanType(), T.BooleanType(), T.LongType(), T.LongType(), T.IntegerType(), T.StringType(), T.StringType()])])
    store = daily.DailyStore(spark, f"file://{tmp_path}/s", shape)
    tx = spark.createDataFrame([("A", DAY, "P", False), ("B", DAY, "P", False), ("A", DAY + dt.timedelta(1), "P", False)], "ticker string, filed_date date, transaction_code string, is_10b51 boolean")
    score = lambda known, items, day: items.select("ticker", F.lit(DAY).alias("signal_date"), "as_of", F.lit(50).alias("score"), F.when(F.col("ticker") == "A", "CLUSTER_BUY").otherwise("BUY").alias("signal_type"), *[F.lit(None).cast(shape[c].dataType).alias(c) for c in daily.SIGNAL[5:]])
    daily.run(store, tx, score, DAY)
    daily.run(store, tx, score, DAY + dt.timedelta(1))
    assert [(r.ticker, r.run_date) for r in store.outbox.read().collect()] == [("A", DAY)]
    assert sorted((r.ticker, r.as_of.day, r.alerted) for r in store.signals.read().collect()) == [("A", 27, True), ("B", 26, False)]


def test_where_a_run_starts():
    assert daily.first_day(None, DAY) == DAY - dt.timedelta(7)
    assert daily.first_day(DAY - dt.timedelta(2), DAY) == DAY - dt.timedelta(2)
    assert daily.first_day(DAY - dt.timedelta(30), DAY) == DAY - dt.timedelta(7)


PERSON = "name string, role string, shares_bought long, price double, total_value decimal(20,2), date date, in_scoring_window boolean, purchase_count long"


def test_alert_text_and_evidence(spark):
    from decimal import Decimal

    people = [("Ann", "cfo", 12345, 10.005, Decimal("123500.00"), DAY, True, 2), ("Bob", "director", 7, 3.0, Decimal("21.00"), DAY - dt.timedelta(3), False, 1), ("Cid", None, None, None, None, None, True, 1)]
    row = ("A", "CLUSTER_BUY", 55, True, 3, people, '{"role_cfo":15,"cap_mid":0,"first_purchase_12mo":-10}', "mid", DAY, DAY)
    df = spark.createDataFrame([row], f"ticker string, signal_type string, score int, cluster_flag boolean, insider_count int, insiders array<struct<{PERSON}>>, breakdown string, cap_tier string, filed_date date, signal_date date")
    companies = spark.createDataFrame([("A", "Acme", 3_000_000_000)], "ticker string, name string, market_cap long")
    quotes = spark.createDataFrame([("A", 103.4, 100.0)], "ticker string, current_price double, low_52wk double")
    full = evidence.evidence_json(evidence.alert_text(evidence.market_context(df, companies, quotes)))
    got = full.first()
    assert got.message.split("\n") == [
        "CLUSTER BUY $A Acme", "Score 55/100", "3 insiders, $124K total, 1997-06-23 to 1997-06-26", "Ann (Cfo), 2 purchases, 1997-06-26: 12,345 sh avg $10.01 = $124K", "Bob (Director), 1997-06-23: 7 sh at $3.00 = $21.00 (earlier)",
        got.message.split("\n")[5], "Mid-cap, 3% above 52-week low", "First Purchase 12mo -10, Role Cfo +15", "Filed 1997-06-26",
    ]
    of = evidence.evidence_field
    assert tuple(full.select(of("filed_date"), of("score_breakdown.role_cfo"), of("insiders[1].total_value").cast("decimal(20,2)"), of("near_low"), of("no.such")).first()) == ("1997-06-26", "15", Decimal("21.00"), "true", None)
    assert '"total_value":21.00' in got.evidence and '"date":"1997-06-23"' in got.evidence
    lone = df.withColumn("cluster_flag", F.lit(False)).withColumn("signal_type", F.lit("BUY")).withColumn("cap_tier", F.lit("unknown")).withColumn("breakdown", F.lit("{}"))
    lines = evidence.alert_text(evidence.market_context(lone, companies.where("false"), quotes.where("false"))).first().message.split("\n")
    assert lines[:3] == ["BUY $A", "Score 55/100", "Insider purchase"] and lines[-1] == "Filed 1997-06-26" and len(lines) == 7


def test_evolved_files(spark, tmp_path):
    spark.createDataFrame([(1, "5")], "k int, n string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, "x", None), (3, None, 9)], "k long, n string, extra int").write.parquet(f"{tmp_path}/b")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("added", T.DateType())])
    paths = [f"{tmp_path}/a", f"{tmp_path}/b"]
    assert sorted(map(tuple, tables.read_evolved(spark, paths, schema, "rest").collect())) == [(1, 5, None, None), (2, None, None, '{"n":"x"}'), (3, None, None, '{"extra":9}')]
    assert tables.read_evolved(spark, paths, schema).columns == ["k", "n", "added"]


def test_facets_count_exactly_at_the_threshold(spark):
    df = spark.range(5000).select((F.col("id") % 12).alias("twelve"), (F.col("id") % 13).alias("thirteen"), F.col("id").alias("many"), F.lit(None).cast("string").alias("none"))
    assert {r.column: (r.n_distinct, r.filter) for r in feeds.facets(df).collect()} == {"twelve": (12, "members"), "thirteen": (13, "contains"), "many": (13, "contains"), "none": (0, "members")}


def test_existence_and_latest_signals(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(k)) for k in range(30)] + [("B", DAY)], "ticker string, signal_date date")
    assert feeds.exists(df).first().found and not feeds.exists(df.where("false")).first().found
    got = feeds.latest_signals(df)
    assert got.count() == 21 and got.where("ticker = 'A'").agg(F.min("signal_date")).first()[0] == dt.date(2020, 1, 11)


def test_runs_share_the_returns_of_their_trades(spark, small, monkeypatch):
    """Three merges with prices serve both runs: each run made six of its own before."""
    from tradelens.plans import runs

    merges = []
    plain = runs.prices.as_of_returns
    count = lambda *args, **named: merges.append(args) or plain(*args, **named)
    monkeypatch.setattr(runs.prices, "as_of_returns", count)
    monkeypatch.setattr(runs.event_study, "as_of_returns", count)
    monkeypatch.setattr(runs.run_store, "run_rows", lambda returns, small, weak, day, threshold: returns.limit(1))
    monkeypatch.setattr(runs.run_store, "save", lambda *args: None)
    runs._saved_runs(spark, small)
    assert len(merges) == 3
