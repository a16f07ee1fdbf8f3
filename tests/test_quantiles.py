"""Quantiles and as-of lookups against plain Python."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tradelens.operators import prices, quantiles

SHARES = {"p25": 0.25, "p50": 0.5, "p99": 0.99, "least": 0.0}


def plain(values, share):
    ordered, p = sorted(values), (len(values) - 1) * share
    lo, hi = math.floor(p), math.ceil(p)
    return ordered[lo] if lo == hi else (hi - p) * ordered[lo] + (p - lo) * ordered[hi]


def test_one_group_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(2**40)) / 7.0 - 5e9).alias("v"))
    got = quantiles.exact(df, ["g"], "v", SHARES, small=2_000).first()
    values = np.sort(df.select("v").toPandas()["v"].to_numpy())
    assert len(np.unique(values)) > 999_000
    assert [got[k] for k in SHARES] == [plain(values, s) for s in SHARES.values()]
    assert quantiles.exact(df, ["g"], "v", {"p50": 0.5}).first().p50 == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_many_groups_ties_extremes_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in range(20) for v in rng.normal(size=int(rng.integers(1, 60))) * 10.0 ** rng.integers(-200, 200)]
    rows += [(None, 1.0)] * 500 + [(None, float(k)) for k in range(40)] + [(30, None), (31, float("inf")), (31, float("-inf")), (31, 1.0), (31, 2.0), (32, 1.7e308), (32, -1.7e308), (32, 5.0), (32, 6.0)] + [(33, 0.1)] * 300
    df = spark.createDataFrame(rows, "g int, v double")
    for small in (5, 100_000):
        got = {r.g: r for r in quantiles.exact(df, ["g"], "v", SHARES, cells=8, small=small).collect()}
        assert len(got) == len({g for g, _ in rows})
        for g in got:
            values = [v for h, v in rows if h == g and v is not None]
            for name, share in SHARES.items():
                assert got[g][name] == (plain(values, share) if values else None), (g, name, small)
    assert quantiles.exact(df.where("false"), ["g"], "v", SHARES).count() == 0


def test_bars_around_points_meets_plain_search(spark):
    rng = np.random.default_rng(2)
    day0 = dt.date(2000, 1, 1)
    bars = {(t, int(d)): float(rng.integers(1, 100)) for t in "AB" for d in rng.choice(4000, 60, replace=False)}
    spans = sorted({(t, int(s), int(s + n)) for t in "ABC" for s, n in zip(rng.integers(-50, 4100, 150), rng.choice([0, 5, 30, 180, 900], 150))})
    frame = spark.createDataFrame([(t, day0 + dt.timedelta(d), c) for (t, d), c in bars.items()] + [("A", day0, None), ("A", None, 1.0)], "ticker string, date date, close double")
    asked = spark.createDataFrame([(t, day0 + dt.timedelta(a), day0 + dt.timedelta(b)) for t, a, b in spans], "ticker string, start_date date, end_date date")
    got = {(r.ticker, (r.start_date - day0).days, (r.end_date - day0).days): (r.start_close, r.end_close) for r in prices.as_of_returns(asked, frame).collect()}
    known = 0
    for t, a, b in spans:
        near = sorted((d, c) for (x, d), c in bars.items() if x == t and a <= d < b + 7)
        inside = [c for d, c in near if d <= b]
        want = (near[0][1], inside[-1] if inside else None) if len(near) >= 2 else (None, None)
        assert got[t, a, b] == want, (t, a, b)
        known += want[0] is not None
    assert known > 30


def test_as_of_makes_no_pairs(spark):
    """Two thousand spans of 180 days over daily bars: the rows that are merged are spans and bars, not their pairs."""
    bars = spark.range(3000).select(F.lit("A").alias("ticker"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
    spans = spark.range(2000).select(F.lit("A").alias("ticker"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("start_date")).withColumn("end_date", F.date_add("start_date", 180))
    out = prices.as_of_returns(spans, bars)
    assert out.where("end_close = start_close + 180").count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "sequence" not in plan
