"""Boundaries of the rules on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tradelens import schemas
from tradelens.functions import columns as C
from tradelens.operators import clusters, cooldown, dedup, event_study, factors, history, prices, ranges, scoring, tables

D = date


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_amendment_removes_a_row(spark):
    df = one(spark, "k string, filed date, acc string, plan boolean", ("a", D(2020, 1, 2), "1", False), ("a", D(2020, 1, 5), "2", True), ("b", D(2020, 1, 2), "3", False), ("b", D(2020, 1, 2), "4", False), (None, D(2020, 1, 1), "5", False))
    out = dedup.latest_by_key(df, ["k"], [F.desc("filed"), F.desc("acc")]).where("not plan")
    assert {(r.k, r.acc) for r in out.collect()} == {("b", "4"), (None, "5")}
    assert dedup.latest_by_key(out, ["k"], [F.desc("filed")]).count() == 2


def test_universe(spark):
    df = one(spark, "ticker string", ("A",), ("B",))
    assert dedup.in_universe(df, one(spark, "t string", ("B",))).collect()[0].ticker == "B"
    assert dedup.in_universe(df, df.limit(0)).count() == 2


@pytest.mark.parametrize("gap,want", [(0, "first_purchase_12mo"), (1, "sequenced_buying_30d"), (30, "sequenced_buying_30d"), (31, "prior_purchase_31_365d"), (365, "prior_purchase_31_365d"), (366, "first_purchase_12mo")])
def test_timing(spark, gap, want):
    df = one(spark, "a string, transaction_date date, n int", ("x", D(2020, 12, 31), 1)).unionByName(one(spark, "a string, transaction_date date, n int", ("x", D.fromordinal(D(2020, 12, 31).toordinal() - gap), 0)))
    assert history.prior_purchases(df, ["a"]).where("n = 1").first().timing == want


@pytest.mark.parametrize("earlier,want", [([], None), ([D(2019, 6, 28), D(2018, 6, 1)], True), ([D(2019, 6, 29), D(2018, 6, 1)], False), ([D(2019, 6, 5)], False), ([D(2017, 6, 5), D(2016, 6, 5)], False), ([D(2017, 6, 5), D(2018, 6, 28)], True), ([D(2020, 1, 1)], None), ([D(2019, 12, 31)], False)])
def test_routine(spark, earlier, want):
    df = one(spark, "a string, transaction_date date", ("x", D(2020, 6, 15)), *[("x", e) for e in earlier])
    assert history.routine_flags(df, ["a"]).where("transaction_date = DATE '2020-06-15'").first().routine is want


def test_routine_null_actor(spark):
    df = one(spark, "a string, transaction_date date", (None, D(2020, 6, 15)), (None, D(2019, 6, 1)), (None, D(2018, 6, 1)))
    assert history.routine_flags(df, ["a"]).where("year(transaction_date) = 2020").first().routine is True


def test_episodes(spark):
    df = one(spark, "a string, transaction_date date, total_value long", ("x", D(2020, 1, 1), 1), ("x", D(2020, 1, 31), 2), ("x", D(2020, 3, 2), 4))
    assert rows(history.buying_episodes(df, ["a"]), "n_purchases", "value") == [(1, 4), (2, 3)]


def tx(spark, *lines):
    """(insider, date, value, price, direct, plan, filed)"""
    schema = "ticker string, insider_name string, role_category string, transaction_date date, filed_date date, transaction_code string, total_value double, price_per_share double, is_direct boolean, is_10b51 boolean, n int"
    return spark.createDataFrame([("T", a, "director", d, f or d, "P", v, p, direct, plan, i) for i, (a, d, v, p, direct, plan, f) in enumerate(lines)], schema)


def cluster_of(spark, *lines, as_of=D(2020, 1, 31)):
    items = one(spark, "ticker string, as_of date", ("T", as_of))
    found = clusters.cluster_windows(clusters.members(items, tx(spark, *lines), [F.desc("n")])).collect()
    return (found[0].insider_count, found[0].is_cluster, found[0].tight_cluster) if found else (0, False, False)


def buyer(name, day, value=30_000.0, price=None, direct=True, plan=False, filed=None):
    return (name, D(2020, 1, day), value, price if price is not None else float(ord(name[0])), direct, plan, filed)


def test_cluster_boundaries(spark):
    assert cluster_of(spark, buyer("a", 17), buyer("b", 24), buyer("c", 31)) == (3, True, False)
    assert cluster_of(spark, buyer("a", 16), buyer("b", 24), buyer("c", 31))[0] == 2
    assert cluster_of(spark, buyer("a", 26), buyer("b", 28), buyer("c", 31)) == (3, True, True)
    assert cluster_of(spark, buyer("a", 25), buyer("b", 28), buyer("c", 31)) == (3, True, False)
    assert cluster_of(spark, buyer("a", 26, 24_999.99), buyer("b", 28, 25_000.0), buyer("c", 31))[0] == 2
    assert cluster_of(spark, buyer("a", 26, direct=None), buyer("b", 28, direct=False), buyer("c", 31))[0] == 1
    assert cluster_of(spark, buyer("a", 28, price=9.0), buyer("b", 28, price=9.0), buyer("c", 28, price=9.0), buyer("d", 30))[0] == 1
    assert cluster_of(spark, buyer("a", 31, filed=D(2020, 2, 1)))[0] == 0


def test_plan_amendment_leaves_cluster(spark):
    assert cluster_of(spark, buyer("a", 28), ("a", D(2020, 1, 28), 30_000.0, 97.0, True, True, D(2020, 1, 30)), buyer("b", 29))[0] == 1


def scored(spark, **change):
    base = dict(transaction_code="P", is_10b51=False, total_value=50_000.0, routine=None, is_direct=True, role_category="cfo", cap_tier="small", shares=10.0, shares_after=100.0, timing="prior_purchase_31_365d", price_per_share=10.0, low_52wk=None) | change
    schema = "transaction_code string, is_10b51 boolean, total_value double, routine boolean, is_direct boolean, role_category string, cap_tier string, shares double, shares_after double, timing string, price_per_share double, low_52wk double"
    return scoring.score_purchases(spark.createDataFrame([base], schema)).first()


def test_scores(spark):
    assert scored(spark).score == 15 + 15 + 15 + 15
    assert scored(spark).breakdown == {"role_cfo": 15, "cap_small": 15, "holdings_increase_5pct": 15, "prior_purchase_31_365d": 15}
    assert (scored(spark, total_value=1999.99).disqualifier, scored(spark, total_value=2000.0).disqualifier, scored(spark, total_value=None).disqualifier) == ("trivial_value", None, "trivial_value")
    assert scored(spark, routine=True).score == 0 and scored(spark, routine=True).breakdown == {}
    assert scored(spark, is_10b51=True, routine=True).disqualifier == "10b5_1_plan"
    assert scored(spark, is_direct=False).score == 45 and scored(spark, is_direct=None).score == 60
    assert scored(spark, role_category=None).breakdown["role_other"] == 0
    assert scored(spark, cap_tier="odd").breakdown["cap_odd"] == 5
    assert "holdings_increase_5pct" not in scored(spark, shares_after=10.0).breakdown
    assert "holdings_increase_5pct" in scored(spark, shares=5.0, shares_after=105.0).breakdown
    assert scored(spark, low_52wk=10 / 1.05).breakdown.get("near_52wk_low_5pct") == 12 or scored(spark, low_52wk=9.6).breakdown["near_52wk_low_5pct"] == 12
    assert scored(spark, low_52wk=9.2).breakdown["near_52wk_low_10pct"] == 7
    assert scored(spark, role_category="ceo", timing="first_purchase_12mo", cap_tier="mid", shares_after=None, is_direct=False).score == -30


@pytest.mark.parametrize("score,cluster,average,tight,want", [(44, False, None, False, "LOW"), (45, False, None, False, "WATCH"), (59, False, None, False, "WATCH"), (60, False, None, False, "BUY"), (29, True, 22, False, "WATCH"), (30, True, 22, False, "CLUSTER_BUY"), (29, True, 22, True, "CLUSTER_BUY"), (90, True, 21, True, "WATCH")])
def test_classes(spark, score, cluster, average, tight, want):
    df = one(spark, "s int, c boolean, a int, t boolean", (score, cluster, average, tight))
    assert df.select(scoring.signal_class(F.col("s"), F.col("c"), F.coalesce("a", "s"), F.col("t"))).first()[0] == want


SIG = "ticker string, signal_date date, score int, signal_type string"


def sig(spark, *lines):
    return spark.createDataFrame([("T", D(2020, 1, d), s, t) for d, s, t in lines], SIG)


def days(df):
    return sorted(r.signal_date.day for r in df.collect())


def test_greedy_cooldown(spark):
    assert days(cooldown.greedy(sig(spark, (1, 60, "BUY"), (7, 60, "BUY")))) == [1]
    assert days(cooldown.greedy(sig(spark, (1, 60, "BUY"), (8, 60, "BUY")))) == [1, 8]
    assert days(cooldown.greedy(sig(spark, (1, 60, "BUY"), (3, 69, "BUY"), (4, 70, "BUY")))) == [1, 4]
    assert days(cooldown.greedy(sig(spark, (1, 50, "WATCH"), (2, 50, "BUY"), (3, 50, "CLUSTER_BUY")))) == [1, 2, 3]
    assert days(cooldown.greedy(sig(spark, (1, 60, "BUY"), (5, 60, "BUY"), (9, 60, "BUY")))) == [1, 9]  # the middle one anchors nothing


def test_two_passes(spark):
    assert days(cooldown.two_pass(sig(spark, (1, 50, "WATCH"), (3, 50, "CLUSTER_BUY")))) == [3]
    assert days(cooldown.two_pass(sig(spark, (1, 60, "BUY"), (3, 55, "BUY")))) == [1]
    assert days(cooldown.two_pass(sig(spark, (1, 20, "LOW"), (3, 20, "LOW")))) == [1, 3]


def test_late_signal(spark):
    stored = sig(spark, (10, 60, "BUY"))
    assert days(cooldown.against_stored(sig(spark, (4, 60, "BUY"), (3, 60, "BUY"), (5, 70, "BUY"), (16, 50, "BUY"), (17, 50, "BUY")), stored)) == [3, 5, 17]


def test_as_of_returns(spark):
    bars = one(spark, "ticker string, date date, close double", ("A", D(2020, 1, 3), 10.0), ("A", D(2020, 1, 4), None), ("A", D(2020, 1, 10), 12.0), ("A", D(2020, 1, 12), 15.0), ("Z", D(2020, 1, 3), 0.0), ("Z", D(2020, 1, 5), 1.0))
    spans = one(spark, "ticker string, start_date date, end_date date", ("A", D(2020, 1, 1), D(2020, 1, 10)), ("A", D(2020, 1, 4), D(2020, 1, 9)), ("A", D(2020, 1, 13), D(2020, 1, 20)), ("B", D(2020, 1, 1), D(2020, 1, 10)), ("Z", D(2020, 1, 1), D(2020, 1, 10)))
    got = {(r.ticker, r.start_date.day): r.ret and round(r.ret, 6) for r in prices.as_of_returns(spans, bars).collect()}
    assert got == {("A", 1): 20.0, ("A", 4): None, ("A", 13): None, ("B", 1): None, ("Z", 1): None}


def test_lows_and_shares(spark):
    bars = one(spark, "ticker string, date date, close double", ("A", D(2019, 1, 1), 1.0), ("A", D(2020, 1, 1), 5.0), ("A", D(2020, 6, 1), 7.0))
    rows_in = one(spark, "ticker string, transaction_date date", ("A", D(2020, 1, 1)), ("A", D(2020, 1, 2)), ("A", D(2018, 1, 1)))
    assert [r.low_52wk for r in prices.low_at(rows_in, bars).orderBy("transaction_date").collect()] == [None, 1.0, 5.0]
    s = one(spark, "cik string, taxonomy string, form string, end date, val long", ("1", "dei", "10-K", D(2020, 1, 1), 5), ("1", "us-gaap", "8-K", D(2019, 1, 1), 7), ("1", "us-gaap", "10-Q", D(2018, 1, 1), 6))
    assert prices.latest_shares(s).first().shares == 5 and prices.first_known_shares(s).first().shares == 7


RET = "ticker string, signal_date date, start_date date, horizon int, excess double, score int, cap_tier string, signal_type string"


def returns(spark, *values):
    return spark.createDataFrame([("T", D(2020, 1, 1), D.fromordinal(D(2020, 1, 1).toordinal() + i), 30, v, 60, "small", "BUY") for i, v in enumerate(values)], RET)


def test_event_metrics(spark):
    r = event_study.summary(returns(spark, 1.0, 2.0, 4.0, 10.0)).first()
    assert (r.p25_return, r.median_return, r.p75_return, r.hit_rate, r.n) == (1.75, 3.0, 5.5, 100.0, 4)
    assert event_study.summary(returns(spark, 5.0)).first().sharpe is None
    assert event_study.summary(returns(spark, 5.0, 5.0)).first().sharpe is None
    assert event_study.longest_losing_streak(returns(spark, 1.0, -1.0, 0.0, -2.0, 3.0, -1.0)).first()[1] == 3
    assert event_study.longest_losing_streak(returns(spark, 1.0, 1.0)).first()[1] == 0
    assert event_study.risk(returns(spark, -21.0, -20.0, None)).first().pct_loss_gt20 == 50.0
    gap = one(spark, RET, *[(t, D(2020, 1, 1), D(2020, 1, 2), 30, v, 60, "small", "BUY") for t, v in (("A", None), ("B", -40.0), ("C", 5.0), ("Z", None))])
    r = event_study.risk(gap).first()
    assert (r.worst_ticker, r.best_ticker, r.worst_outcome, r.n_no_benchmark) == ("B", "C", -40.0, 2)
    strata = event_study.strata(returns(spark, 1.0, 2.0, 3.0)).cache()
    assert all(x.s == 3 for x in strata.groupBy("dimension").agg(F.sum("n").alias("s")).collect())
    assert strata.count() == 11 and strata.where("n = 0 and avg_return is null").count() == 8
    pivot = {(x.dimension, x.category): (x.avg_30, x.n_30, x.n_60) for x in event_study.strata_pivot(strata).collect()}
    assert pivot["cap_tier", "small"] == (2.0, 3, 0) and pivot["cap_tier", "large"] == (None, 0, 0)
    roll = event_study.rolling_hit_rate(returns(spark, *[1.0] * 20)).collect()
    assert [(x.date.day, x.n) for x in roll] == [(15, 15)]


@pytest.mark.parametrize("seed", range(6))
def test_losing_streak_over_days(spark, seed):
    """Many trades a day: runs are joined over days as a plain scan joins them."""
    import random

    rng = random.Random(seed)
    trades = [(D.fromordinal(D(2020, 1, 1).toordinal() + rng.randrange(12)), f"T{i}", rng.choice([-1.0, -1.0, 0.0, 2.0])) for i in range(40)]
    best = run = 0
    for _, _, v in sorted(trades):
        run = 0 if v > 0 else run + 1
        best = max(best, run)
    df = one(spark, RET, *[(t, D(2020, 1, 1), d, 30, v, 60, "small", "BUY") for d, t, v in trades])
    assert event_study.longest_losing_streak(df).first()[1] == best


def test_eligible_by_signal_date(spark):
    df = one(spark, "ticker string, signal_date date, filed_date date", ("A", D(2020, 1, 1), D(2020, 1, 9)), ("B", D(2020, 1, 2), D(2020, 1, 2)))
    got = event_study.trades(df, F.lit(D(2020, 2, 3)), horizons=(30,)).collect()
    assert [(r.ticker, r.start_date) for r in got] == [("A", D(2020, 1, 13))]


def test_bonus_steps(spark):
    df = one(spark, "n int", (2,), (3,), (9,), (None,))
    assert [r[0] for r in df.select(scoring.step_points({3: 1, 5: 7}, F.col("n"))).collect()] == [0, 1, 7, 0]
    assert not any(schemas.RULES.cluster_size_points.values()) and not any(schemas.RULES.filing_lag_points.values())


def test_lift_ranking(spark):
    df = one(spark, "horizon int, factor string, lift double", (60, "a", None), (60, "b", 0.0), (60, "c", 2.0), (60, "d", -1.0), (90, "e", 9.0))
    assert [r.factor for r in factors.lift_ranking(df, 60).orderBy("place").collect()] == ["c", "b", "d", "a"]


def test_nearest_signal(spark):
    detail = one(spark, "ticker string, start_date date, horizon int, excess double, row_id string", ("T", D(2020, 1, 14), 30, 1.0, "a"), ("T", D(2020, 3, 1), 30, 1.0, "b"))
    sigs = one(spark, "ticker string, signal_date date, score int, breakdown string", ("T", D(2020, 1, 9), 1, "{}"), ("T", D(2020, 1, 11), 2, "{}"), ("T", D(2020, 2, 17), 3, "{}"))
    assert [(r.row_id, r.matched_score) for r in factors.nearest_signals(detail, sigs).collect()] == [("a", 1)]


def test_range_join_meets_once(spark):
    items = one(spark, "k string, at date", *[("x", D(2020, 1, d)) for d in range(1, 31)])
    points = one(spark, "k string, d date", *[("x", D(2020, 1, d)) for d in range(1, 31)])
    assert ranges.join_in_days(items, points, "k", "at", "d", 3, 2).count() == sum(1 for a in range(1, 31) for b in range(1, 31) if -3 <= b - a <= 2)


def test_tables(spark):
    old = one(spark, "k int, a string, b string, kept string", (1, "x", "y", "z"), (2, "x", None, "z"))
    new = one(spark, "k int, a string, b string", (2, "n", "f"), (1, None, None), (3, "n", "f"))
    got = rows(tables.upsert(old, new, ["k"], ["a"], ["b"]), "k", "a", "b", "kept")
    assert got == [(1, None, "y", "z"), (2, "n", "f", "z"), (3, "n", "f", None)]
    assert rows(tables.insert_new(old.select("k"), new.select("k"), ["k"]), "k") == [(1,), (2,), (3,)]
    assert rows(tables.mark(one(spark, "k int, s boolean", (1, None), (2, True), (3, None)), one(spark, "k int", (1,)), ["k"], "s"), "k", "s") == [(1, True), (2, True), (3, False)]
    assert tables.evolve(old, schemas.COMPANIES).columns[:7] == schemas.COMPANIES.fieldNames()
    got = spark.range(1).select(F.explode(tables.fetch_windows(F.lit(D(2020, 1, 1)), F.lit(D(2020, 1, 17)))).alias("w")).select("w.*").collect()
    assert [(r.start.day, r.end.day) for r in got] == [(1, 8), (9, 16), (17, 17)]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "runs")
    tables.replace_partitions(one(spark, "run int, t int, v int", (1, 60, 1), (2, 60, 2)), path, ["run", "t"])
    tables.replace_partitions(one(spark, "run int, t int, v int", (2, 60, 3)), path, ["run", "t"])
    assert rows(spark.read.parquet(path), "run", "v") == [(1, 1), (2, 3)]


def test_columns(spark):
    df = one(spark, "t string", ("Chief Financial Officer",), ("Sales Coordinator",), ("President and CEO",), ("Board Member",), (None,), ("Treasurer",), ("Janitor",))
    assert [r[0] for r in df.select(C.role_category(F.col("t"))).collect()] == ["cfo", "coo", "ceo", "director", "other", "cfo", "other"]
    df = one(spark, "t string", (" nasdaq:abc ",), ("NONE",), ("n/a",), ("",), (None,), ("brk.b",))
    assert [r[0] for r in df.select(C.clean_ticker(F.col("t"))).collect()] == ["ABC", None, None, None, None, "BRK.B"]
    df = one(spark, "t string", ("2020-01-05-05:00",), ("2020-13-05",), ("x",), (None,))
    assert [r[0] for r in df.select(C.date_prefix(F.col("t"))).collect()] == [D(2020, 1, 5), None, None, None]
    df = one(spark, "v double", (None,), (1.5e6,), (25_000.0,), (12.3,))
    assert [r[0] for r in df.select(C.currency(F.col("v"))).collect()] == ["N/A", "$1.5M", "$25K", "$12.30"]
    assert one(spark, "m map<string,int>", ({"role_cfo": 15, "cap_mid": 0},)).select(C.factor_labels(F.col("m"))).first()[0] == ["Role Cfo"]
