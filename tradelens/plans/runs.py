"""Named queries of stored runs and of the daily run, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators import clusters, daily, event_study, evidence, feeds, merged, prices, run_store, scoring, tables
from tradelens.plans import registry
from tradelens.plans import views as V
from tradelens.plans.oracle import ALERTED, ORACLE, SIGNALS
from tradelens.plans.shared import scratch, stored


#: What the metrics of a run read of a trade.
DETAIL = ["ticker", "signal_date", "score", "cap_tier", "signal_type", "horizon", "start_date", "end_date", "_kind"]


def _saved_runs(spark, d) -> str:
    """Two runs of the event study, the second saved twice."""
    path = scratch(spark, "run-store")
    every = registry.all_signals(spark, d).withColumn("filed_date", F.col("as_of"))
    # the return of a trade is that of its days, whichever run looks at it: made once, for the later run, which has all of them
    chosen = event_study.selected(every).withColumn("_kind", F.lit("chosen")).unionByName(event_study.weak_clusters(every).withColumn("_kind", F.lit("weak")))
    entered = event_study.trades(chosen, F.lit(registry.AS_OF).cast("date")).select(*DETAIL)
    own = prices.as_of_returns(entered, V.price_bars(spark, d))
    spans = entered.select("start_date", "end_date").distinct()
    bench = event_study.benchmark_returns(spans, V.benchmark_bars(spark, d))
    small = event_study.benchmark_returns(spans, V.benchmark_bars(spark, d, ("small",))).withColumnRenamed("bench_ret", "small_ret")
    held = stored(own.join(bench, ["start_date", "end_date"], "left").join(small, ["start_date", "end_date"], "left"), "study")
    excess = lambda missing, base, digits: event_study.excess(F.coalesce("ret", F.lit(missing)), F.col(base), digits)
    for day, times in (("1997-12-31", 1), (registry.AS_OF, 2)):
        known = event_study.old_enough(held, F.lit(day).cast("date"))
        strong, v = known.where("_kind = 'chosen'"), F.col("excess")
        returns = strong.withColumn("excess", excess(-50.0, "bench_ret", 2))
        tiny = strong.where("cap_tier = 'small'").withColumn("excess", excess(-50.0, "small_ret", None)).where("excess IS NOT NULL")
        tiny = tiny.groupBy("horizon").agg(F.count("*").alias("n"), F.round(F.avg(v), 2).alias("avg_return"), F.round(F.avg((v > 0).cast("int") * 100.0), 1).alias("hit_rate"))
        weak = known.where("_kind = 'weak'").withColumn("excess", excess(None, "bench_ret", 2)).where("excess IS NOT NULL")
        weak = weak.groupBy("horizon").agg(F.count("*").alias("n"), F.round(F.avg(F.when(v > 0, 100.0).otherwise(0.0)), 1).alias("hit_rate"), F.round(F.avg(v), 2).alias("avg_return"))
        rows = stored(run_store.run_rows(returns, tiny, weak, day, 60), "run")
        for _ in range(times):
            run_store.save(rows, returns.select("ticker", "signal_date", "horizon", "excess"), path)
    return path


def latest_run(spark, d):
    """The stored run of the latest date, its metrics read from their JSON."""
    m = run_store.latest(run_store.runs(spark, _saved_runs(spark, d)))
    return m.select(
        "run_date", "threshold", "horizon_days", "n_trades", "hit_rate", "avg_return", "median_return", "p25_return", "p75_return", "sharpe", "small_cap_avg_return",
        F.col("metrics.distribution.max_loss").alias("max_loss"), F.col("metrics.risk.max_consecutive_losses").alias("max_consecutive_losses"), F.col("metrics.risk.pct_loss_gt20").alias("pct_loss_gt20"), F.col("metrics.risk.n_no_benchmark").alias("n_no_benchmark"),
        F.aggregate("metrics.by_score_band", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_banded"), F.array_join(F.transform("metrics.by_cap_tier", lambda x: F.concat(x.category, F.lit(":"), x.n.cast("string"))), " ").alias("tiers"),
        F.coalesce("metrics.small_caps.n", F.lit(0)).alias("n_small"), F.coalesce("metrics.weak_clusters.n", F.lit(0)).alias("n_weak"), F.coalesce(F.size("metrics.rolling"), F.lit(0)).cast("long").alias("n_rolling"),
    )


def daily_runs(spark, d):
    """Signals and flags after the runs of two consecutive days, the first of which starts a day back."""
    tx = V.transactions(spark, d)
    score = lambda known, items, day: registry.signals_of(spark, d, known, items)
    shape = score(tx, clusters.work_items(tx), None).schema
    store = daily.DailyStore(spark, scratch(spark, "daily"), shape)
    for day in (date(1997, 6, 26), date(1997, 6, 27)):
        daily.run(store, tx, score, day, back=1)
    return store.signals.read().select("ticker", "signal_date", "as_of", "score", "signal_type", "alerted")


def alert_messages(spark, d):
    """Outbox of cluster alerts with their text."""
    return _evidence(spark, d).select("ticker", "signal_date", F.size("insiders").alias("n_insiders"), "message")


def evidence_fields(spark, d):
    """Fields of the stored evidence, read back from its JSON."""
    of = evidence.evidence_field
    rows = stored(evidence.evidence_json(_evidence(spark, d)).select("ticker", "signal_date", "evidence"), "evidence")
    return rows.select(
        "ticker", "signal_date", of("filed_date").cast("date").alias("filed_date"), of("company_name").alias("company_name"), of("cap_tier").alias("cap_tier"), of("market_cap").cast("long").alias("market_cap"), of("near_low").cast("boolean").alias("near_low"),
        of("insiders[0].name").alias("first_insider"), F.round(of("insiders[0].total_value").cast("double"), 2).alias("first_value"), of("insiders[0].date").cast("date").alias("first_date"), of("score_breakdown.cap_small").cast("int").alias("cap_small"),
    )


def _evidence(spark, d):
    tx = registry.all_purchases(spark, d)
    rows = registry.all_signals(spark, d, tx).where("signal_type = 'CLUSTER_BUY'").withColumn("filed_date", F.col("as_of"))
    near = clusters.join_in_days(rows.select("ticker", "as_of"), registry.scored_of(spark, d, tx).where("disqualifier IS NULL"), "ticker", "as_of", "transaction_date", scoring.RULES.scoring_days).where("filed_date <= as_of")
    full = evidence.evidence(rows, evidence.insider_rollup(near, ["ticker", "as_of"]), clusters.members(rows.select("ticker", "as_of"), tx, V.tie()))
    context = evidence.market_context(full, V.companies(spark, d), prices.quotes(V.price_bars(spark, d)))
    return evidence.alert_text(context)


def merged_signals(spark, d):
    """The upsert of signals into a stored table of months: those that the new rows do not touch keep their files."""
    every = registry.all_signals(spark, d).select("ticker", "signal_date", "score", "signal_type", (F.dayofmonth("signal_date") % 2 == 0).alias("alerted"), F.date_format("signal_date", "yyyy-MM").alias("month"))
    table = merged.MergedTable(spark, scratch(spark, "merged"), every.schema, "month")
    table.insert(every.where("signal_date < DATE '1997-01-01'"), ["ticker", "signal_date", "month"])
    new = every.where("signal_date >= DATE '1996-06-01'").withColumn("score", F.col("score") + 1).withColumn("alerted", F.lit(False))
    table.merge(new, ["ticker", "signal_date", "month"], ["score", "signal_type"])
    return table.read().drop("month")


def evolved_orders(spark, d):
    """Three ages of one table (fewer columns, a narrower type, a column of another name) read as one, from files."""
    path = scratch(spark, "evolved")
    o = V.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filed_date"), "o_custkey", "o_orderpriority")
    year = F.year("filed_date")
    o.where(year < 1994).select(F.col("o_orderkey").cast("int").alias("order_id"), "filed_date").write.parquet(f"{path}/age=1")
    o.where((year >= 1994) & (year < 1996)).select(F.col("o_orderkey").alias("order_id"), "filed_date", F.col("o_custkey").cast("int").alias("cik")).write.parquet(f"{path}/age=2")
    o.where(year >= 1996).select(F.col("o_orderkey").alias("order_id"), "filed_date", F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("memo")).write.parquet(f"{path}/age=3")
    schema = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("filed_date", T.DateType()), T.StructField("cik", T.LongType()), T.StructField("note", T.StringType())])
    return tables.read_evolved(spark, [f"{path}/age={k}" for k in (1, 2, 3)], schema, rescued="rest")


def latest_signals(spark, d):
    """The latest 20 signals of each ticker."""
    return feeds.latest_signals(registry.all_signals(spark, d)).select("ticker", "signal_date", "score", "signal_type")


def any_unsent(spark, d):
    """Whether any signal waits to be sent."""
    waiting = feeds.unsent(registry.all_signals(spark, d).withColumn("alerted", F.dayofmonth("signal_date") % 2 == 0))
    return feeds.exists(waiting, "waiting")


NAMES = [latest_run, daily_runs, alert_messages, evidence_fields, merged_signals, evolved_orders, latest_signals, any_unsent]


def _day(day: str) -> str:
    """The signals of one day's work items, from what was filed by then."""
    own = SIGNALS.replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey\n)", f"FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) + CAST(l_orderkey % 5 AS INTEGER) <= DATE '{day}'\n)", 1)
    own = own.replace("SELECT DISTINCT ticker, filed_date AS as_of FROM tx WHERE", f"SELECT DISTINCT ticker, filed_date AS as_of FROM tx WHERE filed_date = DATE '{day}' AND", 1)
    return f"SELECT * FROM ({own} SELECT ticker, signal_date, as_of, score, signal_type FROM signals)"


_CENTS = lambda x: f"CASE WHEN {x} >= 100000000 THEN '$' || format('{{:.1f}}', (({x} + 5000000) // 10000000) / 10.0) || 'M' WHEN {x} >= 100000 THEN '$' || CAST(({x} + 50000) // 100000 AS VARCHAR) || 'K' ELSE '$' || format('{{:.2f}}', {x} / 100.0) END"
_LABELS = [
    ("cap_small", "Cap Small +15", "s.best_order IS NOT NULL AND s.cap_tier = 'small'"), ("cap_unknown", "Cap Unknown +5", "s.best_order IS NOT NULL AND s.cap_tier = 'unknown'"), ("first_purchase_12mo", "First Purchase 12mo -10", "s.b_timing = 'first_purchase_12mo'"),
    ("holdings_increase_5pct", "Holdings Increase 5pct +15", "s.b_hold > 0"), ("indirect_purchase", "Indirect Purchase -15", "s.b_indirect < 0"), ("near_52wk_low_10pct", "Near 52wk Low 10pct +7", "s.b_low = 7"), ("near_52wk_low_5pct", "Near 52wk Low 5pct +12", "s.b_low = 12"),
    ("prior_purchase_31_365d", "Prior Purchase 31 365d +15", "s.b_timing = 'prior_purchase_31_365d'"), ("role_ceo", "Role Ceo -5", "s.b_role = 'ceo'"), ("role_cfo", "Role Cfo +15", "s.b_role = 'cfo'"), ("role_coo", "Role Coo +15", "s.b_role = 'coo'"),
    ("role_director", "Role Director +16", "s.b_role = 'director'"), ("role_officer", "Role Officer +12", "s.b_role = 'officer'"), ("sequenced_buying_30d", "Sequenced Buying 30d +10", "s.b_timing = 'sequenced_buying_30d'"),
]
_FACTOR_LINE = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for _, label, c in _LABELS) + ")"
_PEOPLE = f"""{SIGNALS}, own AS (SELECT * FROM signals WHERE signal_type = 'CLUSTER_BUY'),
people AS (
  SELECT w.ticker, w.as_of, insider_name AS name, arg_min(role_category, CASE role_category WHEN 'cfo' THEN 1 WHEN 'ceo' THEN 2 WHEN 'chairman' THEN 3 WHEN 'director' THEN 4 WHEN 'coo' THEN 5 WHEN 'officer' THEN 6 ELSE 7 END) AS role, CAST(sum(shares) AS BIGINT) AS shares,
    sum(shares * price_cents) / sum(shares) AS price, CAST(sum(value_cents) AS BIGINT) AS cents, max(transaction_date) AS day, TRUE AS scored, count(*) AS n
  FROM win w WHERE disqualifier IS NULL GROUP BY w.ticker, w.as_of, insider_name
),
every AS (
  SELECT * FROM people UNION ALL
  SELECT m.ticker, m.as_of, m.insider_name, m.role_category, m.shares, m.price_cents, m.value_cents, m.transaction_date, FALSE, 1 FROM members m WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.ticker = m.ticker AND p.as_of = m.as_of AND p.name = m.insider_name)
),
last AS (SELECT ticker, max(date) AS d, arg_max(close, date) AS cur FROM bars GROUP BY ticker),
quote AS (SELECT l.ticker, any_value(cur) AS cur, min(b.close) AS low FROM last l JOIN bars b ON b.ticker = l.ticker AND b.date >= l.d - 365 GROUP BY l.ticker),
ctx AS (SELECT c.ticker, c.name AS company_name, c.market_cap, q.cur, q.low, coalesce((q.cur - q.low) / q.low * 100 <= 10, FALSE) AS near_low FROM companies c LEFT JOIN quote q ON q.ticker = c.ticker)"""
_NAME = "upper(role[1]) || role[2:]"

ORACLE_RUNS = {
    "latest_run": f"""SELECT DATE '1998-12-31' AS run_date, 60 AS threshold, s.horizon AS horizon_days, s.n AS n_trades, s.hit_rate, s.avg_return, s.median_return, s.p25_return, s.p75_return, s.sharpe, sc.avg_return AS small_cap_avg_return,
  s.max_loss, k.max_consecutive_losses, r.pct_loss_gt20, r.n_no_benchmark, b.n_banded, t.tiers, coalesce(sc.n, 0) AS n_small, coalesce(w.n, 0) AS n_weak, coalesce(ro.n, 0) AS n_rolling
FROM ({ORACLE["event_study_summary"]}) s JOIN ({ORACLE["event_study_risk"]}) r ON r.horizon = s.horizon LEFT JOIN ({ORACLE["event_study_streak"]}) k ON k.horizon = s.horizon
LEFT JOIN ({ORACLE["event_study_small_caps"]}) sc ON sc.horizon = s.horizon LEFT JOIN ({ORACLE["event_study_weak_clusters"]}) w ON w.horizon = s.horizon
LEFT JOIN (SELECT horizon, count(*) AS n FROM ({ORACLE["event_study_rolling"]}) GROUP BY horizon) ro ON ro.horizon = s.horizon
LEFT JOIN (SELECT horizon, CAST(sum(n) AS BIGINT) AS n_banded FROM ({ORACLE["event_study_strata"]}) WHERE dimension = 'score_band' GROUP BY horizon) b ON b.horizon = s.horizon
LEFT JOIN (SELECT horizon, string_agg(category || ':' || n, ' ' ORDER BY category) AS tiers FROM ({ORACLE["event_study_strata"]}) WHERE dimension = 'cap_tier' GROUP BY horizon) t ON t.horizon = s.horizon""",
    "daily_runs": f"""WITH days AS ({_day("1997-06-25")} UNION ALL {_day("1997-06-26")} UNION ALL {_day("1997-06-27")}), sent AS (SELECT DISTINCT ticker, signal_date FROM days WHERE signal_type = 'CLUSTER_BUY')
SELECT d.ticker, d.signal_date, max(as_of) AS as_of, arg_max(score, as_of) AS score, arg_max(signal_type, as_of) AS signal_type, any_value(s.ticker) IS NOT NULL AS alerted
FROM days d LEFT JOIN sent s ON s.ticker = d.ticker AND s.signal_date = d.signal_date GROUP BY d.ticker, d.signal_date""",
    "alert_messages": f"""{_PEOPLE},
told AS (
  SELECT ticker, as_of, count(*) AS n, CAST(sum(cents) AS BIGINT) AS spent, CAST(min(day) AS VARCHAR) AS lo, CAST(max(day) AS VARCHAR) AS hi,
    string_agg(name || ' (' || {_NAME} || ')' || CASE WHEN n > 1 THEN ', ' || n || ' purchases' ELSE '' END || ', ' || day || ': ' || format('{{:,}}', shares) || ' sh' || CASE WHEN n > 1 THEN ' avg $' ELSE ' at $' END || format('{{:.2f}}', floor(round(price, 4) + 0.5) / 100) || ' = ' || {_CENTS("cents")} || CASE WHEN scored THEN '' ELSE ' (earlier)' END, chr(10) ORDER BY name) AS buyers
  FROM every GROUP BY ticker, as_of
)
SELECT s.ticker, s.signal_date, CAST(t.n AS INTEGER) AS n_insiders, 'CLUSTER BUY $' || s.ticker || ' ' || c.company_name || chr(10) || 'Score ' || s.score || '/100' || chr(10) || s.insider_count || ' insiders, ' || {_CENTS("spent")} || ' total, ' || CASE WHEN lo = hi THEN lo ELSE lo || ' to ' || hi END || chr(10) || buyers
  || CASE WHEN s.cap_tier <> 'unknown' OR near_low THEN chr(10) || concat_ws(', ', CASE WHEN s.cap_tier <> 'unknown' THEN upper(s.cap_tier[1]) || s.cap_tier[2:] || '-cap' END, CASE WHEN near_low THEN CAST(floor(round((c.cur - c.low) / c.low * 100, 6) + 0.5) AS INTEGER) || '% above 52-week low' END) ELSE '' END
  || CASE WHEN {_FACTOR_LINE} <> '' THEN chr(10) || {_FACTOR_LINE} ELSE '' END || chr(10) || 'Filed ' || s.as_of AS message
FROM own s JOIN told t ON t.ticker = s.ticker AND t.as_of = s.as_of JOIN ctx c ON c.ticker = s.ticker""",
    "evidence_fields": f"""{_PEOPLE}, heads AS (SELECT ticker, as_of, min(name) AS name, arg_min(cents, name) / 100 AS value, arg_min(day, name) AS day FROM every GROUP BY ticker, as_of)
SELECT s.ticker, s.signal_date, s.as_of AS filed_date, c.company_name, s.cap_tier, c.market_cap, c.near_low, h.name AS first_insider, round(h.value, 2) AS first_value, h.day AS first_date, CASE WHEN s.best_order IS NOT NULL AND s.cap_tier = 'small' THEN 15 END AS cap_small
FROM own s JOIN heads h ON h.ticker = s.ticker AND h.as_of = s.as_of JOIN ctx c ON c.ticker = s.ticker""",
    "merged_signals": ORACLE["upsert_signals"],
    "evolved_orders": """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS filed_date, CASE WHEN year(CAST(o_orderdate AS DATE)) >= 1994 THEN o_custkey END AS cik, CAST(NULL AS VARCHAR) AS note,
  CASE WHEN year(CAST(o_orderdate AS DATE)) >= 1996 THEN '{"memo":"' || o_orderpriority || '"}' END AS rest FROM orders""",
    "latest_signals": f"{SIGNALS} SELECT ticker, signal_date, score, signal_type FROM signals QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY signal_date DESC) <= 20",
    "any_unsent": f"{SIGNALS} SELECT count(*) > 0 AS waiting FROM signals WHERE NOT {ALERTED} AND (score >= 60 OR cluster_flag)",
}
