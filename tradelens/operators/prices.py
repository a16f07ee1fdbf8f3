"""As-of prices, returns, lows and market values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.columns import cap_tier, market_cap, percent_change


def bars_around(points: DataFrame, bars: DataFrame, key: str, at: str = "at", width: int = 366) -> DataFrame:
    """Add ``before`` (the last bar on or before the point) and ``after`` (the first on or after it), as (date, close).

    One ordered merge: points and bars stand together in the order of their days, a bar before the points of
    its day, and each point takes the bar last seen, and that of its day or the next one: one sort and no
    pair. A series has one bar a day. The order is that of a (key, bucket of
    ``width`` days), so a long series is spread over its buckets; what a bucket's first points lack comes
    over its edge from the last bar of the buckets before, and likewise at its end.
    """
    day = F.unix_date(F.col("_at"))
    bar = F.struct(F.col("date"), F.col("close"))
    laid = bars.where("close IS NOT NULL AND date IS NOT NULL").select(key, F.col("date").alias("_at"), bar.alias("_bar"))
    both = points.withColumn("_at", F.col(at)).withColumn("_p", F.lit(True)).unionByName(laid.withColumn("_p", F.lit(False)), allowMissingColumns=True).withColumn("_bucket", F.floor(day / width))
    over = f"OVER (PARTITION BY `{key}`, _bucket ORDER BY _at, _p"
    seen = both.withColumns({"before": F.expr(f"last(_bar) IGNORE NULLS {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), "_next": F.expr(f"lead(_bar) IGNORE NULLS {over})")}).where("_p")
    seen = seen.withColumn("after", F.when(F.col("before.date") == F.col("_at"), F.col("before")).otherwise(F.col("_next"))).drop("_p", "_bar", "_at", "_next")

    edges = laid.withColumn("_bucket", F.floor(day / width)).groupBy(key, "_bucket").agg(F.min("_bar").alias("_first"), F.max("_bar").alias("_last"))
    buckets = points.select(key, F.floor(F.unix_date(at) / width).alias("_bucket")).distinct().join(edges.withColumn("_has", F.lit(True)), [key, "_bucket"], "full_outer")
    order = Window.partitionBy(key)
    carried = buckets.select(key, "_bucket", F.last("_last", ignorenulls=True).over(order.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.last("_first", ignorenulls=True).over(order.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_right"))
    met = seen.join(carried, [key, "_bucket"], "left")
    return met.withColumn("before", F.coalesce("before", "_left")).withColumn("after", F.coalesce("after", "_right")).drop("_bucket", "_left", "_right")


def as_of_returns(spans: DataFrame, bars: DataFrame, key: str = "ticker", start: str = "start_date", end: str = "end_date", slack: int = 7, name: str = "ret") -> DataFrame:
    """Add start_close (first close on or after start), end_close (last close on or before end) and the return.

    Null unless two days from start to less than ``slack`` days after end have a bar. Each distinct span is three
    points (its start, its end, the last day of its slack) that are merged with the bars: spans of all
    lengths in one pass, and no row for a bar within them. A series has one bar a day.
    """
    distinct = spans.select(key, start, end).distinct()
    marks = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("at")) for i, c in enumerate((F.col(start), F.col(end), F.date_add(end, slack - 1)))])
    points = distinct.select(key, start, end, F.explode(marks).alias("m")).select(key, start, end, "m.i", "m.at")
    own = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    found = bars_around(points, bars, key).groupBy(key, start, end).agg(own(0, "after").alias("_a"), own(1, "before").alias("_b"), own(2, "before").alias("_c"))
    inside = F.col("_b.date") >= F.col(start)
    found = found.where("_a.date < _c.date").select(key, start, end, F.col("_a.close").alias("start_close"), F.when(inside, F.col("_b.close")).alias("end_close"))
    found = found.withColumn(name, percent_change(F.col("start_close"), F.col("end_close")))
    return spans.join(found, [key, start, end], "left")


def trailing_low(bars: DataFrame, key: str = "ticker", days: int = 365) -> DataFrame:
    """Add ``low``: the least close of the ``days`` days up to each bar."""
    w = Window.partitionBy(key).orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    return bars.withColumn("low", F.min("close").over(w))


def year_of(date, days: int = 365):
    """The year, of ``days`` + 1 days, in which ``low_at`` looks for a date."""
    return F.floor(F.unix_date(date) / (days + 1))


def low_at(df: DataFrame, bars: DataFrame, date: str = "transaction_date", key: str = "ticker", days: int = 365) -> DataFrame:
    """Add ``low_52wk``: the least close of the ``days`` days up to the row's date.

    These days are the end of one year (of ``days`` + 1 days) and the start of the next. The least close of a
    start is one that no earlier close of its year undercuts, that of an end one that no later close does:
    of a series only these few records of each year meet the rows, by key, and each row looks in its year's.
    Rows that are dealt by key, and bars dealt by (key, ``_year``), are not shuffled again.
    """
    return low_from(df, year_lows(bars, key, days), date, key, days)


def year_lows(bars: DataFrame, key: str = "ticker", days: int = 365) -> DataFrame:
    """key and ``_lows``: for each year the few bars in which ``low_from`` looks for the lows of its dates."""
    own = bars if "_year" in bars.columns else bars.withColumn("_year", year_of("date", days)).repartition(key, "_year")
    own = own.where("close IS NOT NULL AND date IS NOT NULL").select(key, "_year", F.struct("date", "close").alias("_bar"))
    w, seen = Window.partitionBy(key, "_year"), (Window.unboundedPreceding, -1)
    least = lambda order: F.min("_bar.close").over(w.orderBy(order).rowsBetween(*seen))
    record = lambda low: F.coalesce(F.col("_bar.close") < low, F.lit(True))
    own = own.select(key, "_year", "_bar", record(least(F.asc("_bar.date"))).alias("_start"), record(least(F.desc("_bar.date"))).alias("_end"))
    years = F.array_compact(F.array(F.when(F.col("_start"), F.col("_year")), F.when(F.col("_end"), F.col("_year") + 1)))
    lows = own.where("_start OR _end").select(key, F.struct(F.unix_date("_bar.date").alias("day"), F.col("_bar.close").cast("double").alias("close")).alias("_bar"), F.explode(years).alias("_year"))
    lows = lows.groupBy(key, "_year").agg(F.collect_list("_bar").alias("_lows"))
    return lows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_year", "_lows"))).alias("_lows"))


def low_from(df: DataFrame, lows: DataFrame, date: str = "transaction_date", key: str = "ticker", days: int = 365) -> DataFrame:
    """Add ``low_52wk`` from the ``year_lows`` of the same key and ``days``."""
    inside = lambda b: (b["day"] >= F.col("_since")) & (b["day"] <= F.col("_day"))
    low = F.aggregate("_own", F.lit(None).cast("double"), lambda a, b: F.when(inside(b), F.least(a, b["close"])).otherwise(a))
    met = df.join(lows, key, "left").withColumns({"_own": F.try_element_at("_lows", year_of(date, days)), "_day": F.unix_date(date), "_since": F.unix_date(date) - days})
    return met.withColumn("low_52wk", low).select(*df.columns, "low_52wk")


def quotes(bars: DataFrame, key: str = "ticker", days: int = 365) -> DataFrame:
    """Latest close and trailing low per series."""
    known = bars.where("close IS NOT NULL")
    last = known.groupBy(key).agg(F.max("date").alias("_last"))
    recent = known.join(last, key).where(F.col("date") >= F.date_sub("_last", days))
    return recent.groupBy(key).agg(F.max_by("close", "date").alias("current_price"), F.min("close").alias("low_52wk"), F.max("date").alias("quote_date"))


def latest_shares(series: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q", "10-K/A", "10-Q/A")) -> DataFrame:
    """Per cik the value with the latest end date among the forms."""
    return series.where(F.col("form").isin(*forms) & F.col("val").isNotNull()).groupBy("cik").agg(F.max_by("val", F.struct("end", "val")).alias("shares"))


def first_known_shares(frames: DataFrame, order: tuple[str, ...] = ("us-gaap", "dei", "concept")) -> DataFrame:
    """Per cik the value of the first taxonomy that has one, of its latest period."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("taxonomy"))
    return frames.where((rank > 0) & F.col("val").isNotNull()).groupBy("cik").agg(F.min_by("val", F.struct(rank, -F.unix_date("end"), "val")).alias("shares"))


def market_caps(companies: DataFrame, shares: DataFrame, prices: DataFrame, force: bool = False) -> DataFrame:
    """Refreshed market_cap and cap_tier of companies that lack one (all if forced); the others as they are."""
    stale = F.lit(force) | (F.coalesce("market_cap", F.lit(0)) == 0) | (F.coalesce("cap_tier", F.lit("unknown")) == "unknown")
    joined = companies.join(shares, "cik", "left").join(prices.select("ticker", "current_price"), "ticker", "left")
    fresh = market_cap(F.col("shares"), F.col("current_price"))
    return joined.withColumn("market_cap", F.when(stale, F.coalesce(fresh, "market_cap")).otherwise(F.col("market_cap"))).withColumn("cap_tier", cap_tier(F.col("market_cap"))).select(*companies.columns)
