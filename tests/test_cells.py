"""Signals keep to few shuffles and small frames, with the results of plain pairs."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tradelens.operators import clusters, history, prices, ranges, scoring
from tradelens.plans import registry
from tradelens.plans import views as V

DAY = date(1997, 1, 1)


def shuffles(df) -> int:
    """The shuffles of the plan before it is run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_give_each_pair_once(spark):
    rng = random.Random(5)
    items = [(k, rng.randint(0, 400)) for k in "ab" for _ in range(60)]
    points = [(k, rng.randint(0, 400), n) for n, k in enumerate("ab" * 80)]
    left = spark.createDataFrame(sorted({(k, DAY + timedelta(t)) for k, t in items}), "k string, at date")
    right = spark.createDataFrame([(k, DAY + timedelta(t), n) for k, t, n in points] + [("a", None, -1)], "k string, d date, n int")
    plain = ranges.join_in_days(left, right, "k", "at", "d", 9)
    found = ranges.join_cells(left, ranges.in_cells(right, "k", "d", 9), "k", "at", "d", 9)
    rows = lambda df: sorted(map(tuple, df.select("k", "at", "d", "n").collect()))
    assert rows(found) == rows(plain)


def test_members_and_signals_are_shuffled_once(spark, small):
    """Items, purchases and nothing between them: pairs were shuffled three times by members, once by signals."""
    tx = registry.purchases(V.transactions(spark, small)).localCheckpoint()
    items = clusters.work_items(tx).localCheckpoint()
    found = clusters.members(items, tx, V.tie())
    assert shuffles(clusters.cluster_windows(found)) == 2
    one = registry.scored_of(spark, small, tx).localCheckpoint()
    assert shuffles(scoring.signals(items, one, clusters.cluster_windows(found).localCheckpoint(), V.tie())) <= 4


def test_versions_hold_until_the_next_better_one(spark):
    """What counted on each day is what ranking all versions filed by that day gives."""
    rng = random.Random(8)
    rows = [("T", f"I{rng.randint(0, 4)}", DAY + timedelta(t), DAY + timedelta(t + rng.randint(0, 12)), rng.random() < 0.3, rng.choice([10.0, 11.0]), n) for n, t in enumerate(rng.choice(range(0, 60, 3)) for _ in range(150))]
    shape = "ticker string, insider_name string, transaction_date date, filed_date date, is_10b51 boolean, price_per_share double, n int"
    tx = spark.createDataFrame(rows, shape).withColumns({"transaction_code": F.lit("P"), "is_direct": F.lit(True), "total_value": F.lit(90_000)})
    days = [DAY + timedelta(t) for t in range(80)]
    got = clusters.members(spark.createDataFrame([("T", d) for d in days], "ticker string, as_of date"), tx, [F.desc("n")])
    got = {(r.as_of, r.n) for r in got.collect()}
    want = set()
    for d in days:
        latest: dict = {}
        for r in sorted((r for r in rows if d - timedelta(14) <= r[2] <= d and r[3] <= d), key=lambda r: (r[3], r[6])):
            latest[r[1], r[2]] = r
        buyers: dict = {}
        for r in sorted((r for r in latest.values() if not r[4]), key=lambda r: (r[2], r[6])):
            buyers[r[1]] = r
        own = list(buyers.values())
        want |= {(d, r[6]) for r in own if sum((x[5], x[2]) == (r[5], r[2]) for x in own) < 3}
    assert got == want


def test_year_low_is_that_of_all_bars(spark):
    rng = random.Random(3)
    bars = [(k, DAY + timedelta(t), float(rng.randint(1, 60))) for k in "ab" for t in rng.sample(range(1500), 300)]
    points = [(k, DAY + timedelta(rng.randint(-20, 1900)), n) for n, k in enumerate("abc" * 150)]
    found = prices.low_at(spark.createDataFrame(points, "ticker string, transaction_date date, n int"), spark.createDataFrame(bars, "ticker string, date date, close double"))
    want = {n: min((c for key, d, c in bars if key == k and t - timedelta(365) <= d <= t), default=None) for k, t, n in points}
    assert {r.n: r.low_52wk for r in found.collect()} == want


def test_points_and_bars_are_sorted_once(spark):
    rng = random.Random(5)
    bars = [(k, DAY + timedelta(t), float(n)) for k in "ab" for n, t in enumerate(sorted(rng.sample(range(1200), 120)))]
    points = [(k, DAY + timedelta(rng.randint(-30, 1300)), n) for n, k in enumerate("abc" * 200)] + [("a", None, 600)]
    found = prices.bars_around(spark.createDataFrame(points, "k string, at date, n int"), spark.createDataFrame(bars, "k string, date date, close double"), "k")
    of = lambda key: [(d, c) for k, d, c in bars if k == key]
    want = {n: (max((b for b in of(k) if b[0] <= t), default=None), min((b for b in of(k) if b[0] >= t), default=None)) for k, t, n in points if t}
    got = {r.n: (r.before and tuple(r.before), r.after and tuple(r.after)) for r in found.collect()}
    assert got == want | {600: (None, None)}
    assert any(a == b for a, b in want.values() if a)  # points on the day of a bar
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("IGNORE NULLS" in line or "last(_bar" in line for line in plan.split("== Initial")[0].splitlines() if "Window [" in line) == 1


def test_an_actors_history_is_sorted_once(spark):
    rows = spark.createDataFrame([("a", DAY + timedelta(40 * k)) for k in range(60)], "a string, transaction_date date")
    plan = history.routine_flags(history.prior_purchases(rows, ["a"]), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_whole_rounds_as_round_does(spark):
    values = [0.0, 0.49999999999999994, 0.5, 1.5, 2.5, -0.5, -1.5, -2.4, 104999.49999999999, 104999.5, 1e15 + 0.5, None] + [random.Random(1).uniform(-1e6, 1e6) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert rows.where(~V.whole(F.col("x")).eqNullSafe(F.round("x").cast("long"))).count() == 0


def test_counted_purchases_are_the_scored_ones_without_prices(spark, small):
    tx = registry.purchases(V.transactions(spark, small)).localCheckpoint()
    found = registry.counted_of(tx)
    assert "low_52wk" not in found.columns and shuffles(found) == 1
    rows = lambda df: sorted(map(tuple, df.select(*V.TIE).collect()))
    scored = registry.scored_of(spark, small, tx)
    assert rows(found) == rows(scored.where("disqualifier IS NULL")) and found.count() > 0
    assert scored.where("score <> CASE WHEN disqualifier IS NULL THEN least(aggregate(map_values(breakdown), 0, (a, x) -> a + x), 100) ELSE 0 END").count() == 0
