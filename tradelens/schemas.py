"""Table shapes, factor weights and thresholds.

Weights and thresholds are the tunable surface: operators take them as arguments and use these values
where none are given.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 4)
_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "money": MONEY, "points": T.MapType(T.StringType(), T.IntegerType())}


def _struct(fields: str) -> T.StructType:
    """Built without a session, unlike a DDL string."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


COMPANIES = _struct("cik string, ticker string, name string, sic_code string, market_cap long, cap_tier string, updated_at timestamp")
FILINGS = _struct("accession_number string, cik string, filed_date date, period_date date, fetched_at timestamp")
TRANSACTIONS = _struct(
    "accession_number string, insider_name string, insider_role string, role_category string, transaction_date date, transaction_code string, "
    "shares money, price_per_share money, total_value money, shares_after money, is_10b51 boolean, is_direct boolean, is_routine boolean"
)
SIGNALS = _struct("ticker string, signal_date date, score int, signal_type string, cluster_flag boolean, score_breakdown points, evidence string, alerted boolean, created_at timestamp")
BACKTEST_RUNS = _struct(
    "run_date date, threshold int, horizon_days int, n_trades long, hit_rate double, avg_return double, median_return double, p25_return double, p75_return double, sharpe double, iwm_avg_return double, metrics string, created_at timestamp"
)
PRICE_BARS = _struct("ticker string, date date, close double")
SHARES = _struct("cik string, taxonomy string, period string, form string, end date, val long")

# Points of each factor, by name.
ROLE_POINTS = {"cfo": 15, "director": 16, "coo": 15, "chairman": 0, "officer": 12, "ceo": -5, "other": 0}
CAP_POINTS = {"small": 15, "mid": 0, "large": 0, "unknown": 5}
FACTOR_POINTS = {
    "indirect_purchase": -15,
    "holdings_increase_5pct": 15,
    "sequenced_buying_30d": 10,
    "prior_purchase_31_365d": 15,
    "first_purchase_12mo": -10,
    "near_52wk_low_5pct": 12,
    "near_52wk_low_10pct": 7,
}
# Bonuses of a whole signal, which count nothing at present.
CLUSTER_SIZE_POINTS = {3: 0, 4: 0, 5: 0}
FILING_LAG_POINTS = {0: 0, 1: 0, 2: 0}
# Ranks of types, order of roles, and what stands for no ticker.
TYPE_RANK = {"CLUSTER_BUY": 3, "BUY": 2, "WATCH": 1, "LOW": 0}
ROLE_ORDER = ["cfo", "ceo", "chairman", "director", "coo", "officer", "other"]
EXECUTIVES = ["cfo", "ceo", "coo", "chairman"]
NO_TICKER = ["NONE", "NA", "N/A", "NULL", ""]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the signal rules (fixed values)."""

    cluster_days: int = 14
    cluster_buyers: int = 3
    cluster_value: int = 25_000
    tight_days: int = 5
    scoring_days: int = 6
    trivial_value: int = 2_000
    cluster_average: int = 22
    cluster_best: int = 30
    buy: int = 60
    watch: int = 45
    cooldown_days: int = 7
    cooldown_jump: int = 10
    role_points: dict = field(default_factory=lambda: dict(ROLE_POINTS))
    cap_points: dict = field(default_factory=lambda: dict(CAP_POINTS))
    factor_points: dict = field(default_factory=lambda: dict(FACTOR_POINTS))
    cluster_size_points: dict = field(default_factory=lambda: dict(CLUSTER_SIZE_POINTS))
    filing_lag_points: dict = field(default_factory=lambda: dict(FILING_LAG_POINTS))


RULES = Rules()
