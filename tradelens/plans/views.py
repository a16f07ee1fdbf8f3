"""The given tables seen as the library's canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.columns import cap_tier
from tradelens.operators.prices import year_of

#: Full-row order of lines: no two rows are equal in all of these.
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "value_cents", "l_discount", "l_tax"]


def tie() -> list:
    return [F.desc(c) for c in TIE]


def whole(x: Column) -> Column:
    """``round(x)`` of a double as long, half away from zero, without the decimal that Spark's ``round`` makes of each value."""
    up = F.abs(x)
    n = F.floor(up) + F.when(up - F.floor(up) >= 0.5, 1).otherwise(0)
    return F.when(x < 0, -n).otherwise(n)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order: the line's supplier is the company, the customer the insider."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "cfo").when(F.col("o_orderpriority") == "2-HIGH", "ceo").when(F.col("o_orderpriority") == "3-MEDIUM", "director").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "officer").when(F.col("o_orderpriority") == "5-LOW", "coo").otherwise("other")
    code = F.when(F.col("l_returnflag") == "N", "P").when(F.col("l_returnflag") == "R", "S").otherwise("A")
    date = F.to_date("l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("l_suppkey").cast("string").alias("cik"),
        F.concat(F.lit("I"), (F.col("o_custkey") % 20).cast("string")).alias("insider_name"),
        role.alias("role_category"),
        date.alias("transaction_date"),
        F.date_add(date, (F.col("l_orderkey") % 5).cast("int")).alias("filed_date"),
        code.alias("transaction_code"),
        F.col("l_quantity").cast("long").alias("shares"),
        whole(F.col("l_extendedprice") / F.col("l_quantity") * 100).alias("price_cents"),
        (whole(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price_per_share"),
        F.col("l_extendedprice").cast("decimal(20,2)").alias("total_value"),
        whole(F.col("l_extendedprice") * 100).alias("value_cents"),
        (F.col("l_quantity").cast("long") + F.col("l_partkey") % 400).alias("shares_after"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 4 == 1)).alias("is_10b51"),
        (F.col("l_linenumber") % 5 != 0).alias("is_direct"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax",
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.when(F.col("s_acctbal") >= 0, (F.col("s_acctbal") * 1_500_000).cast("decimal(24,0)").cast("long"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cik"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("name"), cap.alias("market_cap"), cap_tier(cap).alias("cap_tier"))


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price per company and day, in whole cents."""
    cents = whole(F.col("l_extendedprice") / F.col("l_quantity") * 100)
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"), cents.alias("c"))
    return lines.groupBy("ticker", "date").agg(F.expr("sum(c) div count(*)").cast("double").alias("close"))


def yearly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``price_bars`` by cik, dealt by (cik, ``_year``) before they are averaged: ``prices.low_at`` keeps to that."""
    cents = whole(F.col("l_extendedprice") / F.col("l_quantity") * 100)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("cik"), F.to_date("l_shipdate").alias("date"), cents.alias("c"))
    dealt = lines.withColumn("_year", year_of("date")).repartition("cik", "_year")
    return dealt.groupBy("cik", "_year", "date").agg(F.expr("sum(c) div count(*)").cast("double").alias("close"))


def benchmark_bars(spark: SparkSession, sf_dir: str, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """Mean price per day over all companies, or over those of some tiers."""
    cents = whole(F.col("l_extendedprice") / F.col("l_quantity") * 100)
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"), cents.alias("c"))
    if tiers:
        lines = lines.join(companies(spark, sf_dir).where(F.col("cap_tier").isin(*tiers)).select("ticker"), "ticker", "left_semi")
    return lines.groupBy("date").agg(F.expr("sum(c) div count(*)").cast("double").alias("close"))


def event_purchases(df: DataFrame) -> DataFrame:
    """Purchase events as dense trades; works on batches and streams."""
    k = F.get_json_object("props", "$.k").cast("long")
    return df.where("event_type = 'purchase'").select(
        F.concat(F.lit("E"), (k % 10).cast("string")).alias("ticker"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("insider_name"),
        F.lit("other").alias("role_category"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("transaction_date"),
        F.to_date("ts").alias("filed_date"),
        F.lit("P").alias("transaction_code"),
        (1 + F.col("event_id") % 3).alias("shares"),
        (F.floor(F.col("value") / 20) * 20).cast("long").alias("price_per_share"),
        F.round(F.col("value") * 1000).cast("long").alias("total_value"),
        F.lit(False).alias("is_10b51"),
        (F.col("event_id") % 7 != 0).alias("is_direct"),
        "event_id",
    )


# -- the same views in SQL, for the oracle

SQL_TX = """
tx AS (
  SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_suppkey AS VARCHAR) AS cik, 'I' || CAST(o_custkey % 20 AS VARCHAR) AS insider_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'cfo' WHEN '2-HIGH' THEN 'ceo' WHEN '3-MEDIUM' THEN 'director' WHEN '4-NOT SPECIFIED' THEN 'officer' WHEN '5-LOW' THEN 'coo' ELSE 'other' END AS role_category,
    CAST(l_shipdate AS DATE) AS transaction_date, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 5 AS INTEGER) AS filed_date,
    CASE l_returnflag WHEN 'N' THEN 'P' WHEN 'R' THEN 'S' ELSE 'A' END AS transaction_code,
    CAST(l_quantity AS BIGINT) AS shares, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS price_cents, round(l_extendedprice / l_quantity * 100) / 100 AS price_per_share,
    CAST(l_extendedprice AS DECIMAL(20,2)) AS total_value, CAST(round(l_extendedprice * 100) AS BIGINT) AS value_cents,
    CAST(l_quantity AS BIGINT) + l_partkey % 400 AS shares_after, (l_linestatus = 'F' AND l_linenumber % 4 = 1) AS is_10b51, (l_linenumber % 5 <> 0) AS is_direct,
    l_orderkey, l_linenumber, l_partkey, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
SQL_TIE = ", ".join(f"{c} DESC" for c in TIE)
SQL_LATEST = f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cik, insider_name, transaction_date, transaction_code ORDER BY filed_date DESC, {SQL_TIE}) AS rn FROM tx
),
latest AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1 AND transaction_code = 'P' AND NOT is_10b51)"""
SQL_COMPANIES = """
co AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS cik, 'T' || CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS name,
    CASE WHEN s_acctbal >= 0 THEN CAST(CAST(s_acctbal * 1500000 AS DECIMAL(24,0)) AS BIGINT) END AS market_cap FROM supplier
),
companies AS (SELECT *, CASE WHEN market_cap IS NULL THEN 'unknown' WHEN market_cap < 2000000000 THEN 'small' WHEN market_cap < 10000000000 THEN 'mid' ELSE 'large' END AS cap_tier FROM co)"""
SQL_BARS = """
lines AS (SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS c FROM lineitem),
bars AS (SELECT ticker, date, CAST(sum(c) // count(*) AS DOUBLE) AS close FROM lines GROUP BY ALL),
bench AS (SELECT date, CAST(sum(c) // count(*) AS DOUBLE) AS close FROM lines GROUP BY ALL)"""
SQL_EVENTS = """
ev AS (
  SELECT 'E' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS ticker, 'U' || CAST(user_id AS VARCHAR) AS insider_name, 'other' AS role_category,
    ts, CAST(ts AS DATE) AS transaction_date, CAST(ts AS DATE) AS filed_date, 1 + event_id % 3 AS shares, CAST(floor(value / 20) * 20 AS BIGINT) AS price_per_share,
    CAST(round(value * 1000) AS BIGINT) AS total_value, event_id % 7 <> 0 AS is_direct, event_id
  FROM events WHERE event_type = 'purchase'
)"""
