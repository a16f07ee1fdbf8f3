"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

from tradelens.plans.views import SQL_BARS, SQL_COMPANIES, SQL_EVENTS, SQL_LATEST, SQL_TIE, SQL_TX

WITH = f"WITH {SQL_TX}"
LATEST = f"{WITH}{SQL_LATEST}"

_MONTHS = """
hits AS (SELECT DISTINCT cik, insider_name, month(transaction_date) AS m, year(transaction_date) AS y FROM tx WHERE transaction_code = 'P' AND day(transaction_date) <= 28),
firsts AS (SELECT cik, insider_name, min(year(transaction_date)) AS fy FROM tx WHERE transaction_code = 'P' GROUP BY ALL)"""
_ROUTINE = """CASE WHEN f.fy <= year(t.transaction_date) - 1 THEN
  (SELECT count(*) FROM hits h WHERE h.cik = t.cik AND h.insider_name = t.insider_name AND h.m = month(t.transaction_date) AND h.y BETWEEN year(t.transaction_date) - 3 AND year(t.transaction_date) - 1) >= 2 END"""

# the plan filter of scoring comes after dedup, and routine flags look at latest rows only
_SCORED = f""",
{_MONTHS.replace("FROM tx WHERE transaction_code = 'P'", "FROM latest WHERE true")},
{SQL_COMPANIES},
{SQL_BARS},
timed AS (
  SELECT t.*, max(transaction_date) OVER (PARTITION BY cik, insider_name ORDER BY transaction_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior_date FROM latest t
),
lowed AS (SELECT DISTINCT t.ticker, t.transaction_date, (SELECT min(b.close) FROM bars b WHERE b.ticker = t.ticker AND b.date BETWEEN t.transaction_date - 365 AND t.transaction_date) / 100 AS low FROM (SELECT DISTINCT ticker, transaction_date FROM latest) t),
joined AS (
  SELECT t.*, coalesce(c.cap_tier, 'unknown') AS cap_tier, l.low, {_ROUTINE} AS routine,
    CASE WHEN t.transaction_date - t.prior_date <= 30 THEN 'sequenced_buying_30d' WHEN t.prior_date IS NOT NULL THEN 'prior_purchase_31_365d' ELSE 'first_purchase_12mo' END AS timing
  FROM timed t LEFT JOIN companies c USING (ticker) LEFT JOIN lowed l ON l.ticker = t.ticker AND l.transaction_date = t.transaction_date
  LEFT JOIN firsts f ON f.cik = t.cik AND f.insider_name = t.insider_name
),
flagged AS (
  SELECT *, CASE WHEN total_value < 2000 THEN 'trivial_value' WHEN routine THEN 'routine_trader' END AS disqualifier,
    CASE WHEN low > 0 AND price_per_share > 0 THEN (price_per_share - low) / low * 100 END AS above,
    CASE WHEN NOT is_direct THEN -15 ELSE 0 END AS p_indirect,
    CASE role_category WHEN 'cfo' THEN 15 WHEN 'director' THEN 16 WHEN 'coo' THEN 15 WHEN 'officer' THEN 12 WHEN 'ceo' THEN -5 ELSE 0 END AS p_role,
    CASE cap_tier WHEN 'small' THEN 15 WHEN 'unknown' THEN 5 ELSE 0 END AS p_cap,
    CASE WHEN shares > 0 AND shares_after > shares AND shares >= 0.05 * (shares_after - shares) THEN 15 ELSE 0 END AS p_hold,
    CASE timing WHEN 'sequenced_buying_30d' THEN 10 WHEN 'prior_purchase_31_365d' THEN 15 ELSE -10 END AS p_time
  FROM joined
),
scored AS (
  SELECT *, CASE WHEN above <= 5 THEN 12 WHEN above <= 10 THEN 7 ELSE 0 END AS p_low,
    CASE WHEN disqualifier IS NULL THEN least(100, p_indirect + p_role + p_cap + p_hold + p_time + CASE WHEN above <= 5 THEN 12 WHEN above <= 10 THEN 7 ELSE 0 END) ELSE 0 END AS score FROM flagged
)"""
SCORED = LATEST + _SCORED

_CLUSTERS = f"""
items AS (SELECT DISTINCT ticker, filed_date AS as_of FROM tx WHERE transaction_code = 'P' AND NOT is_10b51),
near AS (
  SELECT i.as_of, t.*, row_number() OVER (PARTITION BY i.ticker, i.as_of, insider_name, transaction_date ORDER BY filed_date DESC, {SQL_TIE}) AS rn2
  FROM items i JOIN tx t ON t.ticker = i.ticker AND t.transaction_date BETWEEN i.as_of - 14 AND i.as_of AND t.filed_date <= i.as_of
  WHERE t.transaction_code = 'P' AND t.is_direct AND t.total_value >= 25000
),
buyers AS (SELECT *, row_number() OVER (PARTITION BY ticker, as_of, insider_name ORDER BY transaction_date DESC, {SQL_TIE}) AS rn3 FROM near WHERE rn2 = 1 AND NOT is_10b51),
counted AS (SELECT *, count(*) OVER (PARTITION BY ticker, as_of, price_per_share, transaction_date) AS same FROM buyers WHERE rn3 = 1),
members AS (SELECT *, lead(transaction_date, 2) OVER (PARTITION BY ticker, as_of ORDER BY transaction_date, insider_name) - transaction_date AS span FROM counted WHERE same < 3),
clusters AS (
  SELECT ticker, as_of, count(*) AS insider_count, count(*) >= 3 AS is_cluster,
    count(*) >= 3 AND bool_or(role_category IN ('cfo', 'ceo', 'coo', 'chairman')) AS executive_cluster, count(*) >= 3 AND coalesce(bool_or(span <= 5), false) AS tight_cluster
  FROM members GROUP BY ALL
)"""

_SIGNALS = f""",
{_CLUSTERS},
win AS (
  SELECT i.as_of, s.*, row_number() OVER (PARTITION BY i.ticker, i.as_of ORDER BY score DESC, {SQL_TIE}) AS rn4
  FROM items i JOIN scored s ON s.ticker = i.ticker AND s.transaction_date BETWEEN i.as_of - 6 AND i.as_of AND s.filed_date <= i.as_of
),
grouped AS (
  SELECT ticker, as_of, greatest(max(score), 0) AS score, CAST(trunc(sum(score) FILTER (disqualifier IS NULL) / count(*) FILTER (disqualifier IS NULL)) AS INTEGER) AS average, max(transaction_date) AS signal_date,
    max(cap_tier) AS cap_tier, min(filed_date - transaction_date) AS min_lag, count(*) AS n_purchases,
    max(CASE WHEN rn4 = 1 AND score > 0 THEN l_orderkey END) AS best_order, max(CASE WHEN rn4 = 1 AND score > 0 THEN role_category END) AS b_role, max(CASE WHEN rn4 = 1 AND score > 0 THEN p_indirect END) AS b_indirect,
    max(CASE WHEN rn4 = 1 AND score > 0 THEN p_role END) AS b_prole, max(CASE WHEN rn4 = 1 AND score > 0 THEN p_hold END) AS b_hold, max(CASE WHEN rn4 = 1 AND score > 0 THEN timing END) AS b_timing, max(CASE WHEN rn4 = 1 AND score > 0 THEN p_low END) AS b_low
  FROM win GROUP BY ALL
),
typed AS (
  SELECT g.*, coalesce(c.insider_count, 0) AS insider_count, coalesce(c.is_cluster, false) AS cluster_flag, coalesce(c.executive_cluster, false) AS executive_cluster, coalesce(c.tight_cluster, false) AS tight_cluster
  FROM grouped g LEFT JOIN clusters c ON c.ticker = g.ticker AND c.as_of = g.as_of
),
classed AS (
  SELECT *, CASE WHEN cluster_flag THEN CASE WHEN coalesce(average, score) >= 22 AND (tight_cluster OR score >= 30) AND cap_tier <> 'large' THEN 'CLUSTER_BUY' ELSE 'WATCH' END
    WHEN score >= 60 THEN 'BUY' WHEN score >= 45 THEN 'WATCH' ELSE 'LOW' END AS signal_type FROM typed
),
signals AS (
  SELECT *, CASE signal_type WHEN 'CLUSTER_BUY' THEN 3 WHEN 'BUY' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, signal_date ORDER BY as_of DESC) AS rn5 FROM classed) WHERE rn5 = 1
)"""
SIGNALS = SCORED + _SIGNALS


def _study(pick: str, bench: str = "bench", missing: str = "-50.0", excess: str = "round({x}, 2)") -> str:
    return f""",
chosen AS (SELECT * FROM signals WHERE {pick}),
entered AS (SELECT c.*, h.horizon, c.as_of + 4 AS start_date, c.as_of + 4 + h.horizon AS end_date FROM chosen c, (VALUES (30), (60), (90), (180)) h(horizon) WHERE c.signal_date + h.horizon + 3 <= DATE '1998-12-31'),
spans AS (SELECT DISTINCT ticker, start_date, end_date FROM entered),
own AS (
  SELECT s.ticker, s.start_date, s.end_date, count(*) AS n, arg_min(b.close, b.date) AS s0, arg_max(b.close, b.date) FILTER (b.date <= s.end_date) AS s1
  FROM spans s JOIN bars b ON b.ticker = s.ticker AND b.date >= s.start_date AND b.date < s.end_date + 7 GROUP BY ALL
),
dates AS (SELECT DISTINCT start_date, end_date FROM entered),
base AS (
  SELECT s.start_date, s.end_date, count(*) AS n, arg_min(b.close, b.date) AS s0, arg_max(b.close, b.date) FILTER (b.date <= s.end_date) AS s1
  FROM dates s JOIN {bench} b ON b.date >= s.start_date AND b.date < s.end_date + 7 GROUP BY ALL
),
raw AS (
  SELECT e.*, coalesce(CASE WHEN o.n >= 2 AND o.s0 <> 0 THEN (o.s1 - o.s0) / o.s0 * 100 END, {missing}) AS ret, CASE WHEN b.n >= 2 AND b.s0 <> 0 THEN (b.s1 - b.s0) / b.s0 * 100 END AS bench_ret
  FROM entered e LEFT JOIN own o ON o.ticker = e.ticker AND o.start_date = e.start_date AND o.end_date = e.end_date LEFT JOIN base b ON b.start_date = e.start_date AND b.end_date = e.end_date
),
study AS (SELECT *, {excess.format(x="(ret - bench_ret)")} AS excess FROM raw)"""


#: Signals as of one day, from what was filed by then.
LIVE = SIGNALS.replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey\n)", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) + CAST(l_orderkey % 5 AS INTEGER) <= DATE '1997-06-30'\n)", 1).replace(
    "SELECT DISTINCT ticker, filed_date AS as_of FROM tx WHERE", "SELECT DISTINCT ticker, DATE '1997-06-30' AS as_of FROM tx WHERE filed_date >= DATE '1997-06-23' AND", 1
)
SELECTED = "(score >= 60 OR cluster_flag) AND signal_type IN ('BUY', 'CLUSTER_BUY')"
STUDY = SIGNALS + _study(SELECTED)
METRICS = """count(excess) AS n, round(avg(CASE WHEN excess > 0 THEN 100.0 ELSE 0.0 END), 1) AS hit_rate, round(avg(excess), 2) AS avg_return,
  round(quantile_cont(excess, 0.5), 4) AS median_return, round(quantile_cont(excess, 0.25), 4) AS p25_return, round(quantile_cont(excess, 0.75), 4) AS p75_return, min(excess) AS max_loss, max(excess) AS max_gain"""
STRATA = f"""{STUDY}, st AS (
  SELECT horizon, excess, 'score_band' AS dimension, CASE WHEN score < 35 THEN NULL WHEN score < 50 THEN '35-49' WHEN score < 65 THEN '50-64' WHEN score < 75 THEN '65-74' WHEN score < 85 THEN '75-84' ELSE '85+' END AS category FROM study
  UNION ALL SELECT horizon, excess, 'cap_tier', cap_tier FROM study UNION ALL SELECT horizon, excess, 'signal_type', signal_type FROM study),
fixed(dimension, category) AS (VALUES ('score_band', '35-49'), ('score_band', '50-64'), ('score_band', '65-74'), ('score_band', '75-84'), ('score_band', '85+'), ('cap_tier', 'small'), ('cap_tier', 'mid'), ('cap_tier', 'large'), ('cap_tier', 'unknown'), ('signal_type', 'CLUSTER_BUY'), ('signal_type', 'BUY')),
grouped_st AS (SELECT horizon, dimension, category, {METRICS} FROM st WHERE excess IS NOT NULL GROUP BY horizon, dimension, category),
strata AS (
  SELECT h.horizon, f.dimension, f.category, coalesce(g.n, 0) AS n, hit_rate, avg_return, median_return, p25_return, p75_return, max_loss, max_gain
  FROM (SELECT DISTINCT horizon FROM study WHERE excess IS NOT NULL) h CROSS JOIN fixed f LEFT JOIN grouped_st g ON g.horizon = h.horizon AND g.dimension = f.dimension AND g.category = f.category)"""
CONVICTION = "CASE WHEN signal_type = 'CLUSTER_BUY' THEN CASE WHEN tight_cluster AND executive_cluster THEN 'PRIME' WHEN tight_cluster OR executive_cluster THEN 'STRONG' ELSE 'CLUSTER' END WHEN score >= 70 THEN 'HIGH' ELSE 'BUY' END"
_FACTORS = [
    ("cap_large", "FALSE"), ("cap_mid", "FALSE"), ("cap_small", "s.cap_tier = 'small'"), ("cap_unknown", "s.cap_tier = 'unknown'"), ("first_purchase_12mo", "s.b_timing = 'first_purchase_12mo'"), ("holdings_increase_5pct", "s.b_hold > 0"),
    ("indirect_purchase", "s.b_indirect < 0"), ("near_52wk_low_10pct", "s.b_low = 7"), ("near_52wk_low_5pct", "s.b_low = 12"), ("prior_purchase_31_365d", "s.b_timing = 'prior_purchase_31_365d'"),
    ("role_ceo", "s.b_role = 'ceo'"), ("role_cfo", "s.b_role = 'cfo'"), ("role_chairman", "FALSE"), ("role_coo", "s.b_role = 'coo'"), ("role_director", "s.b_role = 'director'"), ("role_officer", "s.b_role = 'officer'"), ("role_other", "FALSE"), ("sequenced_buying_30d", "s.b_timing = 'sequenced_buying_30d'"),
]
_MATCHED = """,
pairs AS (
  SELECT d.ticker, d.signal_date AS own_date, d.horizon, d.excess, s.score AS matched_score, s.best_order IS NOT NULL AS has, s.* EXCLUDE (ticker, signal_date, score),
    row_number() OVER (PARTITION BY d.ticker, d.signal_date, d.horizon ORDER BY abs(d.start_date - s.signal_date - 4), s.signal_date) AS rn6
  FROM study d JOIN signals s ON s.ticker = d.ticker AND s.signal_type IN ('BUY', 'CLUSTER_BUY') AND abs(d.start_date - s.signal_date - 4) <= 8 WHERE d.excess IS NOT NULL
),
matched AS (SELECT * FROM pairs WHERE rn6 = 1)"""
_LIFT = ",\nfac AS (" + " UNION ALL ".join(f"SELECT horizon, excess, '{f}' AS factor, coalesce(has AND ({c}), FALSE) AS w FROM matched s" for f, c in _FACTORS) + """),
lift AS (
  SELECT horizon, factor, count(*) FILTER (w) AS n_with, count(*) FILTER (NOT w) AS n_without, round(CAST(sum(CAST(round(excess * 100) AS BIGINT)) FILTER (w) AS DOUBLE) / (100 * count(*) FILTER (w)), 6) AS avg_with, round(CAST(sum(CAST(round(excess * 100) AS BIGINT)) FILTER (NOT w) AS DOUBLE) / (100 * count(*) FILTER (NOT w)), 6) AS avg_without,
    round(CAST(sum(CAST(round(excess * 100) AS BIGINT)) FILTER (w) AS DOUBLE) / (100 * count(*) FILTER (w)) - CAST(sum(CAST(round(excess * 100) AS BIGINT)) FILTER (NOT w) AS DOUBLE) / (100 * count(*) FILTER (NOT w)), 6) AS lift FROM fac GROUP BY ALL
)"""
_WEIGHT = "CASE factor WHEN 'role_cfo' THEN 15 WHEN 'role_director' THEN 16 WHEN 'role_coo' THEN 15 WHEN 'role_officer' THEN 12 WHEN 'role_ceo' THEN -5 WHEN 'cap_small' THEN 15 WHEN 'cap_unknown' THEN 5 WHEN 'indirect_purchase' THEN -15 WHEN 'holdings_increase_5pct' THEN 15 WHEN 'sequenced_buying_30d' THEN 10 WHEN 'prior_purchase_31_365d' THEN 15 WHEN 'first_purchase_12mo' THEN -10 WHEN 'near_52wk_low_5pct' THEN 12 WHEN 'near_52wk_low_10pct' THEN 7 ELSE 0 END"
ALERTED = "(day(signal_date) % 2 = 0)"
_FOLD = """,
numbered AS (SELECT ticker, signal_date, score, signal_type, rank, row_number() OVER (PARTITION BY ticker ORDER BY signal_date) AS k FROM signals),
fold AS (
  SELECT ticker, k, signal_date, score, signal_type, TRUE AS kept, signal_date AS a_date, score AS a_score, rank AS a_rank FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.ticker, n.k, n.signal_date, n.score, n.signal_type, x.stays, CASE WHEN x.stays THEN n.signal_date ELSE f.a_date END, CASE WHEN x.stays THEN n.score ELSE f.a_score END, CASE WHEN x.stays THEN n.rank ELSE f.a_rank END
  FROM fold f JOIN numbered n ON n.ticker = f.ticker AND n.k = f.k + 1,
    LATERAL (SELECT NOT (n.signal_date - f.a_date < 7 AND n.score < f.a_score + 10 AND n.rank <= f.a_rank) AS stays) x
)"""
_TWO = """,
pass1 AS (
  SELECT s.* FROM signals s LEFT JOIN (
    SELECT s2.ticker, s2.signal_date, max(s1.rank * 10000 + s1.score) AS best FROM signals s2 JOIN signals s1 ON s1.ticker = s2.ticker AND s1.signal_date < s2.signal_date AND s2.signal_date - s1.signal_date < 7 AND s1.signal_type <> 'LOW' GROUP BY ALL
  ) b ON b.ticker = s.ticker AND b.signal_date = s.signal_date
  WHERE NOT coalesce(s.rank <= b.best // 10000 AND s.score < b.best % 10000 + 10, FALSE)
),
pass2 AS (
  SELECT s.* FROM pass1 s LEFT JOIN (
    SELECT s1.ticker, s1.signal_date, max(s2.rank * 10000 + s2.score) AS best FROM pass1 s1 JOIN pass1 s2 ON s1.ticker = s2.ticker AND s2.signal_date > s1.signal_date AND s2.signal_date - s1.signal_date < 7 AND s2.signal_type <> 'LOW' GROUP BY ALL
  ) b ON b.ticker = s.ticker AND b.signal_date = s.signal_date
  WHERE NOT coalesce(b.best // 10000 > s.rank OR b.best % 10000 >= s.score + 10, FALSE)
)"""

ORACLE = {
    "latest_amendment": f"{LATEST} SELECT ticker, insider_name, transaction_date, filed_date, value_cents, shares, l_orderkey, l_linenumber FROM latest",
    "routine_flag": f"""{WITH}, {_MONTHS},
r AS (SELECT t.l_orderkey, t.l_linenumber, t.ticker, t.insider_name, t.transaction_date, {_ROUTINE} AS routine FROM tx t JOIN firsts f ON f.cik = t.cik AND f.insider_name = t.insider_name WHERE t.transaction_code = 'P')
SELECT * EXCLUDE (routine), CASE WHEN routine THEN 'routine' WHEN NOT routine THEN 'opportunistic' ELSE '—' END AS label FROM r""",
    "purchase_timing": f"""{LATEST},
p AS (SELECT a.ticker, a.insider_name, a.transaction_date, (SELECT max(b.transaction_date) FROM latest b WHERE b.cik = a.cik AND b.insider_name = a.insider_name AND b.transaction_date BETWEEN a.transaction_date - 365 AND a.transaction_date - 1) AS prior_date FROM latest a)
SELECT *, CASE WHEN transaction_date - prior_date <= 30 THEN 'sequenced_buying_30d' WHEN prior_date IS NOT NULL THEN 'prior_purchase_31_365d' ELSE 'first_purchase_12mo' END AS timing FROM p""",
    "buying_episodes": f"""{LATEST},
g AS (SELECT *, CASE WHEN transaction_date - lag(transaction_date) OVER w <= 30 THEN 0 ELSE 1 END AS s FROM latest WINDOW w AS (PARTITION BY cik, insider_name ORDER BY transaction_date)),
e AS (SELECT *, sum(s) OVER (PARTITION BY cik, insider_name ORDER BY transaction_date) AS ep FROM g)
SELECT cik, insider_name, min(transaction_date) AS first_date, max(transaction_date) AS last_date, count(*) AS n_purchases, CAST(sum(value_cents) AS BIGINT) AS value FROM e GROUP BY cik, insider_name, ep""",
    "cluster_windows": f"{WITH}, {_CLUSTERS} SELECT * FROM clusters WHERE is_cluster",
    "event_clusters": f"""WITH {SQL_EVENTS},
items AS (SELECT DISTINCT ticker, filed_date AS as_of FROM ev),
near AS (SELECT i.as_of, t.*, row_number() OVER (PARTITION BY i.ticker, i.as_of, insider_name ORDER BY transaction_date DESC, event_id DESC) AS rn FROM items i JOIN ev t ON t.ticker = i.ticker AND t.transaction_date BETWEEN i.as_of - 14 AND i.as_of WHERE is_direct AND total_value >= 25000),
c AS (SELECT *, count(*) OVER (PARTITION BY ticker, as_of, price_per_share, transaction_date) AS same FROM near WHERE rn = 1),
m AS (SELECT *, lead(transaction_date, 2) OVER (PARTITION BY ticker, as_of ORDER BY transaction_date, insider_name) - transaction_date AS span FROM c WHERE same < 3)
SELECT ticker, as_of, count(*) AS insider_count, TRUE AS is_cluster, FALSE AS executive_cluster, coalesce(bool_or(span <= 5), FALSE) AS tight_cluster FROM m GROUP BY ticker, as_of HAVING count(*) >= 3""",
    "scored_purchases": f"""{SCORED} SELECT ticker, insider_name, transaction_date, disqualifier, score,
CASE WHEN disqualifier IS NULL THEN 2 + (p_indirect <> 0)::INT + (p_cap > 0)::INT + (p_hold > 0)::INT + (p_low > 0)::INT ELSE 0 END AS n_factors, cap_tier, timing FROM scored""",
    "signals_raw": f"{SIGNALS} SELECT ticker, signal_date, as_of, score, signal_type, cluster_flag, tight_cluster, executive_cluster, insider_count, n_purchases, min_lag FROM signals",
    "signals_cooled": SIGNALS.replace("WITH", "WITH RECURSIVE", 1) + _FOLD + " SELECT ticker, signal_date, score, signal_type FROM fold WHERE kept",
    "signals_deduped": SIGNALS + _TWO + " SELECT ticker, signal_date, score, signal_type FROM pass2",
    "late_signals": f"""{SIGNALS}, b AS (SELECT n.ticker, n.signal_date, max(o.rank * 10000 + o.score) AS best FROM signals n JOIN signals o ON o.ticker = n.ticker AND abs(o.signal_date - n.signal_date) < 7 AND o.as_of < DATE '1997-07-01' AND o.signal_type <> 'LOW' WHERE n.as_of >= DATE '1997-07-01' GROUP BY ALL)
SELECT n.ticker, n.signal_date, n.score, n.signal_type FROM signals n LEFT JOIN b ON b.ticker = n.ticker AND b.signal_date = n.signal_date WHERE n.as_of >= DATE '1997-07-01' AND NOT coalesce(n.score < b.best % 10000 + 10 AND n.rank <= b.best // 10000, FALSE)""",
    "insider_rollup": f"""{LATEST}, o AS (SELECT *, CASE role_category WHEN 'cfo' THEN 1 WHEN 'ceo' THEN 2 WHEN 'chairman' THEN 3 WHEN 'director' THEN 4 WHEN 'coo' THEN 5 WHEN 'officer' THEN 6 ELSE 7 END AS rr FROM latest),
g AS (SELECT ticker, insider_name, CAST(sum(shares) AS BIGINT) AS shares_bought, CAST(sum(total_value) AS DOUBLE) AS total_value, sum(shares * price_per_share) / sum(shares) AS ap, arg_min(role_category, rr) AS role,
  (SELECT max(x.shares_after) FROM o x WHERE x.ticker = a.ticker AND x.insider_name = a.insider_name AND x.transaction_date = max(a.transaction_date)) AS shares_after, count(*) AS purchase_count, min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM o a GROUP BY ticker, insider_name)
SELECT ticker, insider_name, shares_bought, total_value, round(ap, 4) AS avg_price, role, shares_after, purchase_count, first_date, last_date, CASE WHEN shares_after > shares_bought THEN round(shares_bought / (shares_after - shares_bought) * 100, 4) END AS pct_increase FROM g""",
    "asof_returns": f"""{LATEST}, {SQL_BARS}, s AS (SELECT DISTINCT ticker, transaction_date AS start_date, transaction_date + 30 AS end_date FROM latest),
f AS (SELECT s.ticker, s.start_date, s.end_date, count(*) AS n, arg_min(b.close, b.date) AS s0, arg_max(b.close, b.date) FILTER (b.date <= s.end_date) AS s1 FROM s JOIN bars b ON b.ticker = s.ticker AND b.date >= s.start_date AND b.date < s.end_date + 7 GROUP BY ALL)
SELECT s.ticker, s.start_date, s.end_date, s0 AS start_close, s1 AS end_close, CASE WHEN s0 <> 0 THEN round((s1 - s0) / s0 * 100, 4) END AS ret FROM s LEFT JOIN f ON f.ticker = s.ticker AND f.start_date = s.start_date AND f.n >= 2""",
    "price_lows": f"WITH {SQL_BARS}, l AS (SELECT ticker, date, close, min(close) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS low FROM bars) SELECT *, (close - low) / low * 100 <= 10 AS near_low FROM l",
    "event_study_detail": f"{STUDY} SELECT ticker, signal_date, horizon, start_date, end_date, round(ret, 4) AS ret, round(bench_ret, 4) AS bench_ret, excess FROM study",
    "event_study_summary": f"{STUDY} SELECT horizon, {METRICS}, CASE WHEN stddev_samp(excess) > 0 THEN round(avg(excess) / stddev_samp(excess) * sqrt(252.0 / horizon), 2) END AS sharpe FROM study WHERE excess IS NOT NULL GROUP BY horizon",
    "event_study_strata": f"""{STRATA} SELECT *, CASE WHEN n < 10 THEN 'very small' WHEN n < 30 THEN 'small' ELSE '' END AS sample FROM strata""",
    "strata_pivot": f"""{STRATA} SELECT dimension, category, max(avg_return) FILTER (horizon = 30) AS avg_30, coalesce(max(n) FILTER (horizon = 30), 0) AS n_30, max(avg_return) FILTER (horizon = 60) AS avg_60, coalesce(max(n) FILTER (horizon = 60), 0) AS n_60,
max(avg_return) FILTER (horizon = 90) AS avg_90, coalesce(max(n) FILTER (horizon = 90), 0) AS n_90, max(avg_return) FILTER (horizon = 180) AS avg_180, coalesce(max(n) FILTER (horizon = 180), 0) AS n_180 FROM strata GROUP BY dimension, category""",
    "event_study_rolling": f"""{STUDY}, v AS (SELECT horizon, start_date, excess FROM study WHERE excess IS NOT NULL), sp AS (SELECT horizon, min(start_date) AS lo, max(start_date) AS hi FROM v GROUP BY horizon),
c AS (SELECT horizon, CAST(unnest(generate_series(lo, hi, INTERVAL 14 DAY)) AS DATE) AS date FROM sp)
SELECT c.horizon, c.date, round(avg(CASE WHEN excess > 0 THEN 100.0 ELSE 0.0 END), 1) AS hit_rate, count(*) AS n FROM c JOIN v ON v.horizon = c.horizon AND v.start_date BETWEEN c.date - 90 AND c.date GROUP BY c.horizon, c.date HAVING count(*) >= 5""",
    "event_study_streak": f"""{STUDY}, i AS (SELECT horizon, excess, sum(CASE WHEN excess > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY horizon ORDER BY start_date, signal_date, ticker ROWS UNBOUNDED PRECEDING) AS g FROM study WHERE excess IS NOT NULL),
r AS (SELECT horizon, g, count(*) FILTER (excess <= 0) AS n FROM i GROUP BY ALL) SELECT horizon, max(n) AS max_consecutive_losses FROM r GROUP BY horizon""",
    "event_study_risk": f"""{STUDY}, a AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY excess DESC NULLS LAST, ticker DESC, signal_date DESC) AS up, row_number() OVER (PARTITION BY horizon ORDER BY excess NULLS LAST, ticker, signal_date) AS down FROM study)
SELECT horizon, round(avg(CASE WHEN excess < -20 THEN 100.0 WHEN excess IS NOT NULL THEN 0.0 END), 1) AS pct_loss_gt20, min(excess) AS worst_outcome, count(*) FILTER (excess IS NULL) AS n_no_benchmark, max(CASE WHEN up = 1 THEN ticker END) AS best_ticker, max(CASE WHEN down = 1 THEN ticker END) AS worst_ticker FROM a GROUP BY horizon""",
    "event_study_weak_clusters": SIGNALS + _study("signal_type = 'CLUSTER_BUY' AND score < 60", missing="NULL") + f" SELECT horizon, {METRICS} FROM study WHERE excess IS NOT NULL GROUP BY horizon",
    "event_study_small_caps": SIGNALS + ", smallb AS (SELECT date, CAST(sum(c) // count(*) AS DOUBLE) AS close FROM lines JOIN companies USING (ticker) WHERE cap_tier = 'small' GROUP BY ALL)" + _study(f"{SELECTED} AND cap_tier = 'small'", bench="smallb", excess="{x}") + " SELECT horizon, count(*) AS n, round(avg(excess), 2) AS avg_return, round(avg(CASE WHEN excess > 0 THEN 100.0 ELSE 0.0 END), 1) AS hit_rate FROM study WHERE excess IS NOT NULL GROUP BY horizon",
    "signal_coverage": f"{SIGNALS} SELECT min(signal_date) AS first_date, max(signal_date) AS last_date, count(*) FILTER (signal_date <= DATE '1998-12-31' - 33) AS n_complete, min(signal_date) + 33 AS first_result FROM signals WHERE {SELECTED}",
    "factor_lift": STUDY + _MATCHED + _LIFT + " SELECT * FROM lift",
    "score_bands": f"""{STUDY}{_MATCHED}, bd AS (SELECT horizon, excess, CASE WHEN matched_score < 35 THEN '0-35' WHEN matched_score < 45 THEN '35-45' WHEN matched_score < 50 THEN '45-50' WHEN matched_score < 55 THEN '50-55' WHEN matched_score < 60 THEN '55-60' WHEN matched_score < 65 THEN '60-65' WHEN matched_score < 70 THEN '65-70' WHEN matched_score < 75 THEN '70-75' WHEN matched_score < 80 THEN '75-80' WHEN matched_score < 90 THEN '80-90' ELSE '90-101' END AS band FROM matched)
SELECT horizon, band, count(*) AS n, round(avg(excess), 4) AS avg_excess, round(coalesce(stddev_samp(excess), 0), 4) AS sd FROM bd GROUP BY horizon, band""",
    "weight_advice": f"""{STUDY}{_MATCHED}{_LIFT}, m AS (SELECT factor, round(avg(lift), 6) AS avg_lift, max(CASE WHEN horizon = 60 THEN lift END) AS lift_60, max(CASE WHEN horizon = 90 THEN lift END) AS lift_90 FROM lift WHERE horizon IN (60, 90) GROUP BY factor)
SELECT factor, {_WEIGHT} AS weight, lift_60, lift_90, avg_lift, CASE WHEN avg_lift > 5 THEN 'raise' WHEN avg_lift > 2 THEN 'keep' WHEN avg_lift > 0 THEN 'keep, small effect' WHEN avg_lift > -2 THEN 'no clear effect' ELSE 'lower' END AS advice FROM m WHERE avg_lift IS NOT NULL""",
    "monthly_excess": f"{STUDY} SELECT horizon, CAST(date_trunc('month', start_date) AS DATE) AS month, count(*) AS n, round(avg(excess), 4) AS avg_excess FROM study WHERE excess IS NOT NULL GROUP BY 1, 2",
    "signal_feed": f"""{SIGNALS} SELECT ticker, signal_date, signal_type, score, {CONVICTION} AS conviction, rank AS type_rank,
CASE WHEN signal_type <> 'CLUSTER_BUY' THEN 9 WHEN tight_cluster AND executive_cluster THEN 0 WHEN tight_cluster THEN 1 WHEN executive_cluster THEN 2 ELSE 3 END AS quality FROM signals WHERE signal_type IN ('CLUSTER_BUY', 'BUY', 'WATCH') AND cap_tier IN ('small', 'mid', 'unknown')""",
    "signal_headline": f"{SIGNALS} SELECT count(*) AS n, count(*) FILTER (signal_type = 'CLUSTER_BUY') AS clusters, count(*) FILTER (signal_type = 'BUY') AS buys, round(avg(score), 4) AS avg_score FROM signals",
    "top_picks": f"""{SIGNALS}, q AS (SELECT *, CASE WHEN signal_type <> 'CLUSTER_BUY' THEN 9 WHEN tight_cluster AND executive_cluster THEN 0 WHEN tight_cluster THEN 1 WHEN executive_cluster THEN 2 ELSE 3 END AS quality FROM signals WHERE signal_type IN ('CLUSTER_BUY', 'BUY'))
SELECT ticker, signal_date, signal_type, score, {CONVICTION} AS conviction FROM q WHERE rank = (SELECT max(rank) FROM q) ORDER BY quality, score DESC, signal_date DESC, ticker LIMIT 3""",
    "positions": f"""{SIGNALS}, e AS (SELECT ticker, as_of, CAST(sum(total_value) AS DOUBLE) / sum(shares) AS entry FROM win WHERE disqualifier IS NULL GROUP BY ALL), last AS (SELECT ticker, arg_max(close, date) / 100 AS cur FROM bars GROUP BY ticker)
SELECT s.ticker, s.signal_date, s.signal_type, round(entry, 4) AS entry_price, round((cur - entry) / entry * 100, 4) AS return_pct, DATE '1998-12-31' - s.signal_date AS days_in, greatest(90 - (DATE '1998-12-31' - s.signal_date), 0) AS days_left, CASE WHEN DATE '1998-12-31' - s.signal_date >= 90 THEN 'closed' ELSE 'open' END AS status
FROM signals s JOIN e ON e.ticker = s.ticker AND e.as_of = s.as_of LEFT JOIN last l ON l.ticker = s.ticker WHERE {SELECTED}""",
    "entity_history": f"""{WITH}, {_MONTHS}, r AS (SELECT t.*, row_number() OVER (PARTITION BY t.ticker ORDER BY t.transaction_date DESC, {SQL_TIE}) AS k, {_ROUTINE} AS routine FROM tx t JOIN firsts f ON f.cik = t.cik AND f.insider_name = t.insider_name WHERE t.transaction_code = 'P')
SELECT ticker, transaction_date, insider_name, l_orderkey, l_linenumber, value_cents, CASE WHEN routine THEN 'routine' WHEN NOT routine THEN 'opportunistic' ELSE '—' END AS routine_label FROM r WHERE k <= 100""",
    "alert_queue": f"{SIGNALS} SELECT ticker, signal_date, score, signal_type FROM signals WHERE NOT {ALERTED} AND (score >= 60 OR cluster_flag)",
    "daily_summary": f"{SIGNALS} SELECT signal_type, count(*) AS n, count(*) FILTER ({ALERTED}) AS alerted FROM signals GROUP BY signal_type",
    "market_caps": f"""WITH {SQL_COMPANIES}, {SQL_BARS}, h AS (SELECT CAST(p_partkey % 1000 + 1 AS VARCHAR) AS cik, CASE p_partkey % 3 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS r, DATE '1998-01-01' + p_size AS e, p_partkey * 1000 AS val FROM part),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY r, e DESC, val) AS k FROM h) WHERE k = 1), last AS (SELECT ticker, arg_max(close, date) AS cur FROM bars GROUP BY ticker),
n AS (SELECT c.cik, c.ticker, CASE WHEN coalesce(c.market_cap, 0) = 0 OR c.cap_tier = 'unknown' THEN coalesce(CAST(s.val * l.cur AS BIGINT), c.market_cap) ELSE c.market_cap END AS market_cap FROM companies c LEFT JOIN s ON s.cik = c.cik LEFT JOIN last l ON l.ticker = c.ticker)
SELECT *, CASE WHEN market_cap IS NULL THEN 'unknown' WHEN market_cap < 2000000000 THEN 'small' WHEN market_cap < 10000000000 THEN 'mid' ELSE 'large' END AS cap_tier FROM n""",
    "cap_tiers": f"WITH {SQL_COMPANIES} SELECT cap_tier, count(*) AS n, min(market_cap) AS least, max(market_cap) AS most FROM companies GROUP BY cap_tier",
    "universe_slice": "WITH r AS (SELECT c_name AS symbol, row_number() OVER (ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_name) AS k FROM customer) SELECT symbol FROM r WHERE k BETWEEN 101 AND 300 UNION SELECT s_name FROM supplier",
    "upsert_filings": "SELECT o_orderkey AS accession_number, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1997-01-01' THEN o_custkey ELSE o_custkey + 1000000 END AS cik, CAST(o_orderdate AS DATE) AS filed_date FROM orders",
    "event_study_report": f"""{STUDY}, a AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY excess DESC, ticker DESC, signal_date DESC) AS up, row_number() OVER (PARTITION BY horizon ORDER BY excess, ticker, signal_date) AS down FROM study WHERE excess IS NOT NULL),
r AS (SELECT horizon, {METRICS}, CASE WHEN stddev_samp(excess) > 0 THEN round(avg(excess) / stddev_samp(excess) * sqrt(252.0 / horizon), 2) END AS sharpe, round(avg(CASE WHEN excess < -20 THEN 100.0 ELSE 0.0 END), 1) AS pct_loss_gt20,
  max(CASE WHEN down = 1 THEN ticker END) AS worst_ticker, max(CASE WHEN up = 1 THEN ticker END) AS best_ticker FROM a GROUP BY horizon)
SELECT horizon, n, hit_rate, round(hit_rate - 50, 1) AS hit_delta, p25_return, median_return, p75_return, max_loss, max_gain, sharpe, pct_loss_gt20, worst_ticker, best_ticker FROM r""",
    "live_signals": LIVE + " SELECT ticker, signal_date, as_of, score, signal_type, cluster_flag, insider_count, n_purchases FROM signals",
    "lift_ranking": STUDY + _MATCHED + _LIFT + " SELECT row_number() OVER (ORDER BY lift DESC NULLS LAST, factor) AS place, factor, lift FROM lift WHERE horizon = 90",
    "stream_enriched": f"WITH {SQL_EVENTS}, {SQL_COMPANIES} SELECT event_id, ev.ticker, name, cap_tier FROM ev LEFT JOIN companies c ON ev.ticker = 'E' || CAST(CAST(c.cik AS BIGINT) - 1 AS VARCHAR)",
    "upsert_signals": f"""{SIGNALS}, o AS (SELECT * FROM signals WHERE signal_date < DATE '1997-01-01'), n AS (SELECT * FROM signals WHERE signal_date >= DATE '1996-06-01')
SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.signal_date, n.signal_date) AS signal_date, coalesce(n.score + 1, o.score) AS score, coalesce(n.signal_type, o.signal_type) AS signal_type, coalesce(day(o.signal_date) % 2 = 0, FALSE) AS alerted FROM o FULL JOIN n ON o.ticker = n.ticker AND o.signal_date = n.signal_date""",
    "retention": "SELECT l_orderkey AS accession_number, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) >= DATE '1996-12-01' AND CAST(l_shipdate AS DATE) >= DATE '1996-12-01' GROUP BY l_orderkey",
    "fetch_windows": "SELECT DATE '1992-01-01' + CAST(floor((CAST(o_orderdate AS DATE) - DATE '1992-01-01') / 8) * 8 AS INTEGER) AS window_start, count(*) AS n, count(*) >= 50 AS capped FROM orders GROUP BY 1",
    "role_class": """WITH t AS (SELECT p_partkey, concat_ws(' ', CASE p_size % 5 WHEN 0 THEN 'Chief Financial Officer' WHEN 1 THEN 'CEO' WHEN 2 THEN 'Board Member' WHEN 3 THEN 'SVP Sales' END, p_type) AS title FROM part)
SELECT *, CASE WHEN title LIKE 'Chief Financial%' THEN 'cfo' WHEN title LIKE 'CEO%' THEN 'ceo' WHEN title LIKE 'Board Member%' THEN 'director' WHEN title LIKE 'SVP%' THEN 'officer' ELSE 'other' END AS role FROM t""",
    "clean_ticker": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN upper(replace(s_name, '#', '')) WHEN 3 THEN upper(trim(s_name)) END AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier",
    "parse_xml": f"""{WITH} SELECT 'T' || cik AS ticker, transaction_code, 'director' AS role_category, is_direct, is_10b51, CASE WHEN transaction_code = 'S' THEN 'D' ELSE 'A' END AS acquired_disposed, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(shares * price_cents) AS BIGINT) AS value_cents, min(transaction_date) AS first_date FROM tx GROUP BY cik, transaction_code, is_direct, is_10b51""",
    "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "sliding_buyers": f"""WITH {SQL_EVENTS}, w AS (SELECT ticker, insider_name, CAST(transaction_date - k AS DATE) AS window_start FROM ev, (SELECT CAST(unnest(generate_series(0, 14)) AS INTEGER) AS k))
SELECT ticker, window_start, window_start + 14 AS window_end, count(DISTINCT insider_name) AS n_buyers, count(*) AS n_purchases FROM w GROUP BY ticker, window_start""",
}
