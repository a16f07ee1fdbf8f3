"""Per-insider roll-ups, the evidence struct of a signal, and its alert text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.columns import currency, percent_change
from tradelens.schemas import ROLE_ORDER


def role_rank(role: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), role), F.lit(0)), F.lit(99))


def insider_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and insider: shares, value, average price over priced lots, best role, holdings after the
    latest purchase, percent increase, number and dates of purchases. Ties take the larger holding."""
    lot = F.when((F.col("price_per_share") > 0) & (F.col("shares") > 0), F.col("shares"))
    out = df.groupBy(*keys, "insider_name").agg(
        F.sum("shares").alias("shares_bought"),
        F.sum("total_value").alias("total_value"),
        (F.sum(lot * F.col("price_per_share")) / F.sum(lot)).cast("double").alias("avg_price"),
        F.min_by("role_category", F.struct(role_rank(F.col("role_category")), "role_category")).alias("role"),
        F.max_by("shares_after", F.struct("transaction_date", "shares_after")).alias("shares_after"),
        F.count("*").alias("purchase_count"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    )
    before = F.col("shares_after") - F.col("shares_bought")
    return out.withColumn("pct_increase", F.when(before > 0, (F.col("shares_bought") / before * 100).cast("double")))


def evidence(signals: DataFrame, rollup: DataFrame, members: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Add ``evidence``: insiders of the scoring window, cluster members not among them, and citations.

    ``references``: (factor, citation).
    """
    keys = ["ticker", "as_of"]
    scored = rollup.select(*keys, F.struct(F.col("insider_name").alias("name"), "role", "shares_bought", F.col("avg_price").alias("price"), "total_value", F.col("last_date").alias("date"), F.lit(True).alias("in_scoring_window"), "purchase_count").alias("i"))
    earlier = members.join(rollup.select(*keys, "insider_name"), [*keys, "insider_name"], "left_anti")
    earlier = earlier.select(*keys, F.struct(F.col("insider_name").alias("name"), F.col("role_category").alias("role"), F.col("shares").alias("shares_bought"), F.col("price_per_share").cast("double").alias("price"), "total_value", F.col("transaction_date").alias("date"), F.lit(False).alias("in_scoring_window"), F.lit(1).cast("long").alias("purchase_count")).alias("i"))
    people = scored.unionByName(earlier).groupBy(*keys).agg(F.array_sort(F.collect_list("i")).alias("insiders"))
    out = signals.join(people, keys, "left")
    if references is not None:
        cited = signals.select(*keys, F.explode(F.map_keys(F.from_json("breakdown", "map<string,int>"))).alias("factor")).join(references, "factor")
        out = out.join(cited.groupBy(*keys).agg(F.array_sort(F.collect_list("citation")).alias("research_basis")), keys, "left")
    return out


def market_context(signals: DataFrame, companies: DataFrame, quotes: DataFrame, near: float = 10) -> DataFrame:
    """Add the company's name and market value, the price and low of the quote, how far above its low it is, and whether that is near."""
    out = signals.join(companies.select("ticker", F.col("name").alias("company_name"), "market_cap"), "ticker", "left").join(quotes.select("ticker", "current_price", "low_52wk"), "ticker", "left")
    above = F.when(F.col("low_52wk") > 0, percent_change(F.col("low_52wk"), F.col("current_price")))
    return out.withColumn("pct_above_low", above).withColumn("near_low", F.coalesce(above <= near, F.lit(False)))


#: Fields of the stored evidence, besides the people and the factors.
EVIDENCE = ["ticker", "company_name", "score", "signal_type", "cluster_flag", "insider_count", "market_cap", "cap_tier", "current_price", "low_52wk", "pct_above_low", "near_low", "filed_date", "signal_date"]


def evidence_json(df: DataFrame, hold: int = 90) -> DataFrame:
    """Add ``evidence``: all that a message or a page needs of a signal, as JSON (dates and decimals as they print)."""
    points = F.from_json("breakdown", "map<string,int>").alias("score_breakdown")
    return df.withColumn("evidence", F.to_json(F.struct(*EVIDENCE, points, "insiders", F.lit(hold).alias("hold_days"))))


def evidence_field(path: str, of: str = "evidence") -> Column:
    """A field of the stored evidence, as text."""
    return F.get_json_object(of, f"$.{path}")


def factor_points(breakdown: Column) -> Column:
    """Title-cased factors that count something, each with its points, in order of their names."""
    entries = F.filter(F.array_sort(F.map_entries(breakdown)), lambda e: e.value != 0)
    return F.transform(entries, lambda e: F.concat(F.initcap(F.replace(e.key, F.lit("_"), F.lit(" "))), F.lit(" "), F.format_string("%+d", e.value)))


def alert_text(df: DataFrame) -> DataFrame:
    """Add ``message``: what and who (company, score, span of days and sum of a cluster), each buyer with shares,
    price and value, the context (tier, distance from the low), the factors and the filing day, a line each."""
    head = F.concat_ws(" ", F.replace("signal_type", F.lit("_"), F.lit(" ")), F.concat(F.lit("$"), F.col("ticker")), F.when(F.col("company_name") != F.col("ticker"), F.col("company_name")))
    spent = F.aggregate("insiders", F.lit(0).cast("decimal(38,4)"), lambda a, i: (a + F.coalesce(i.total_value, F.lit(0))).cast("decimal(38,4)"))
    days = F.filter(F.transform("insiders", lambda i: i["date"]), lambda x: x.isNotNull())
    lo, hi = F.array_min(days).cast("string"), F.array_max(days).cast("string")
    span = F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit(" to "), hi))
    group = F.when(F.col("cluster_flag"), F.concat_ws(", ", F.concat(F.col("insider_count").cast("string"), F.lit(" insiders")), F.concat(currency(spent), F.lit(" total")), span)).otherwise("Insider purchase")

    def buyer(i: Column) -> Column:
        many = i.purchase_count > 1
        price = F.when(i.price > 0, F.concat(F.when(many, " avg $").otherwise(" at $"), F.format_string("%.2f", F.round(i.price, 6)))).otherwise("")
        who = F.concat_ws(", ", F.concat(i.getField("name"), F.lit(" ("), F.initcap(i.role), F.lit(")")), F.when(many, F.concat(i.purchase_count.cast("string"), F.lit(" purchases"))), i["date"].cast("string"))
        return F.concat(who, F.lit(": "), F.format_string("%,d", F.coalesce(i.shares_bought, F.lit(0)).cast("long")), F.lit(" sh"), price, F.lit(" = "), currency(i.total_value), F.when(i.in_scoring_window, "").otherwise(" (earlier)"))

    filled = lambda text: F.when(text != "", text)
    tier = F.when(F.col("cap_tier") != "unknown", F.concat(F.initcap("cap_tier"), F.lit("-cap")))
    context = F.concat_ws(", ", tier, F.when(F.col("near_low"), F.concat(F.format_string("%.0f", F.round("pct_above_low", 6)), F.lit("% above 52-week low"))))
    factors = F.array_join(factor_points(F.from_json("breakdown", "map<string,int>")), ", ")
    lines = [head, F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit("/100")), group, filled(F.array_join(F.transform("insiders", buyer), "\n")), filled(context), filled(factors), F.concat(F.lit("Filed "), F.col("filed_date").cast("string"))]
    return df.withColumn("message", F.concat_ws("\n", *lines))
