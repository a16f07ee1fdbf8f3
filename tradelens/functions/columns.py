"""Column expressions: parsing, labels, tiers and formats. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelens.schemas import NO_TICKER, TYPE_RANK

# Role patterns in the order in which they are tried.
ROLE_PATTERNS = [
    ("cfo", r"chief financial|cfo|chief finance|finance officer|treasurer"),
    ("ceo", r"chief executive|ceo|chief exec|president and ceo|ceo and president"),
    ("coo", r"chief operating|coo|chief ops"),
    ("chairman", r"chairman|exec chair"),
    ("director", r"\bdirector\b|\btrustee\b|\bboard member\b"),
    ("officer", r"officer|president|vice president|vp |svp|evp|general counsel|secretary|controller|managing"),
]


def lookup(points: dict, key: Column, default: int) -> Column:
    """Points by key; ``default`` for a key that is not listed."""
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def role_category(title: Column, patterns=ROLE_PATTERNS) -> Column:
    """First pattern that the title matches; null or unmatched titles are ``other``."""
    low = F.lower(title)
    out = F.lit("other")
    for name, pattern in reversed(patterns):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def title_or_director(title: Column, is_director: Column) -> Column:
    return F.when((F.coalesce(F.trim(title), F.lit("")) == "") & is_director, F.lit("Director")).otherwise(title)


def date_prefix(text: Column) -> Column:
    """A leading YYYY-MM-DD as a date; null if there is none or it is no date."""
    return F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def number(text: Column, kind: str = "decimal(20,4)") -> Column:
    """A number, or null where the text is none."""
    return F.trim(text).try_cast(kind)


def flag(text: Column) -> Column:
    return F.coalesce(F.trim(text).isin("1", "true", "True", "yes"), F.lit(False))


def names_plan(document: Column) -> Column:
    """Does the document mention a pre-arranged trading plan?

    Only a document with 10b5 in it is put into lower case.
    """
    low = F.lower(document)
    return F.when(document.contains("10b5") | document.contains("10B5"), low.contains("10b5-1") | low.contains("rule 10b5")).otherwise(False)


def clean_ticker(raw: Column) -> Column:
    """Upper case, without an exchange prefix; null for the usual stand-ins for none."""
    last = F.trim(F.element_at(F.split(F.upper(F.trim(raw)), ":"), -1))
    return F.when(~last.isin(NO_TICKER), last)


def short_cik(cik: Column) -> Column:
    return F.ltrim(cik, F.lit("0"))


def padded_cik(cik: Column) -> Column:
    return F.lpad(short_cik(cik), 10, "0")


def total_value(shares: Column, price: Column, code: Column) -> Column:
    value = shares * price
    return F.when(code == "S", F.abs(value)).otherwise(value)


def is_direct(ownership: Column) -> Column:
    return F.coalesce(ownership, F.lit("D")) == "D"


def listing_symbol(symbol: Column) -> Column:
    return F.replace(F.upper(F.trim(symbol)), F.lit("."), F.lit("-"))


def cap_tier(market_cap: Column) -> Column:
    return F.when(market_cap.isNull(), "unknown").when(market_cap < 2_000_000_000, "small").when(market_cap < 10_000_000_000, "mid").otherwise("large")


def market_cap(shares: Column, price: Column) -> Column:
    return (shares * price).cast("long")


def percent_change(start: Column, end: Column) -> Column:
    return F.when(start != 0, (end - start) / start * 100)


def near_low(price: Column, low: Column, percent: float = 10) -> Column:
    return F.coalesce((low > 0) & ((price - low) / low * 100 <= percent), F.lit(False))


def type_rank(signal_type: Column) -> Column:
    return lookup(TYPE_RANK, signal_type, 0)


def conviction(signal_type: Column, score: Column, tight: Column, executive: Column) -> Column:
    tight, executive = F.coalesce(tight, F.lit(False)), F.coalesce(executive, F.lit(False))
    return (
        F.when((signal_type == "CLUSTER_BUY") & tight & executive, "PRIME")
        .when((signal_type == "CLUSTER_BUY") & (tight | executive), "STRONG")
        .when(signal_type == "CLUSTER_BUY", "CLUSTER")
        .when(score >= 70, "HIGH")
        .otherwise("BUY")
    )


def routine_label(is_routine: Column) -> Column:
    return F.when(is_routine, "routine").when(~is_routine, "opportunistic").otherwise("—")


def sample_label(n: Column) -> Column:
    return F.when(n < 10, "very small").when(n < 30, "small").otherwise("")


def currency(value: Column) -> Column:
    return (
        F.when(value.isNull(), "N/A")
        .when(value >= 1_000_000, F.format_string("$%.1fM", (value / 1_000_000).cast("double")))
        .when(value >= 1_000, F.format_string("$%.0fK", (value / 1_000).cast("double")))
        .otherwise(F.format_string("$%.2f", value.cast("double")))
    )


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%+.1f%%", value.cast("double")))


def factor_labels(breakdown: Column) -> Column:
    """Title-cased names of the factors with points, sorted."""
    return F.transform(F.array_sort(F.map_keys(F.map_filter(breakdown, lambda k, v: v != 0))), lambda k: F.initcap(F.replace(k, F.lit("_"), F.lit(" "))))
