"""Readers of landed files and tables; every schema is explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.columns import clean_ticker, padded_cik, short_cik

INDEX_SCHEMA = "hits struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,file_date:string,period_ending:string,form:string>>>>"


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def filing_index(raw: DataFrame) -> DataFrame:
    """Flat records of nested index pages: first cik is the filer, the last the issuer; names end before ``(CIK``."""
    hit = raw.select(F.explode("hits.hits").alias("h"))
    src = F.col("h._source")
    return hit.select(
        F.element_at(F.split("h._id", ":"), 1).alias("accession_number"),
        short_cik(F.try_element_at(src["ciks"], F.lit(-1))).alias("cik"),
        short_cik(F.try_element_at(src["ciks"], F.lit(1))).alias("filer_cik"),
        F.trim(F.split_part(F.try_element_at(src["display_names"], F.lit(-1)), F.lit("(CIK"), F.lit(1))).alias("entity_name"),
        src["file_date"].try_cast("date").alias("filed_date"),
        src["period_ending"].try_cast("date").alias("period_date"),
        src["form"].alias("form"),
    )


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    return filing_index(spark.read.schema(INDEX_SCHEMA).option("multiLine", "true").json(path))


def primary_documents(raw: DataFrame) -> DataFrame:
    """(accession, document) from two parallel arrays; folders of rendered copies are cut off."""
    pair = raw.select(F.explode(F.arrays_zip("accessionNumber", "primaryDocument")).alias("p"))
    return pair.select(F.replace("p.accessionNumber", F.lit("-"), F.lit("")).alias("accession_number"), F.regexp_replace("p.primaryDocument", r"^xsl[^/]*/", "").alias("document"))


def cik_tickers(raw: DataFrame, order: str = "ord") -> DataFrame:
    """One ticker per company: of several the last listed."""
    clean = raw.select(padded_cik(F.col("cik_str")).alias("cik"), clean_ticker(F.col("ticker")).alias("ticker"), order)
    return clean.where("ticker IS NOT NULL").groupBy("cik").agg(F.max_by("ticker", order).alias("ticker"))


def universe(lines: DataFrame) -> DataFrame:
    return lines.select(F.upper(F.trim("value")).alias("ticker")).where("ticker <> ''").distinct()


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return universe(spark.read.text(path))


def price_bars(raw: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Bars from parallel arrays of timestamps (seconds) and closes; null closes go."""
    pair = raw.select(ticker, F.explode(F.arrays_zip("timestamp", "close")).alias("p"))
    return pair.where("p.close IS NOT NULL").select(ticker, F.to_date(F.timestamp_seconds("p.timestamp")).alias("date"), F.col("p.close").alias("close"))


def share_frames(raw: DataFrame) -> DataFrame:
    """Bulk frames: one row per company, taxonomy and period."""
    return raw.select("taxonomy", "period", F.explode("data").alias("d")).select(padded_cik(F.col("d.cik").cast("string")).alias("cik"), "taxonomy", "period", F.col("d.end").try_cast("date").alias("end"), F.col("d.val").cast("long").alias("val"))


def listing(df: DataFrame, country: str | None = None) -> DataFrame:
    """Constituents with symbol and market_cap: the columns are found by name.

    A symbol is one to five letters after ``.`` has become ``-`` and nothing else. A value that is no
    number counts as 0; where the listing is limited to a ``country``, only rows with a value above 0 stay.
    """
    names = {c.lower(): c for c in df.columns}
    symbol = next(names[n] for n in ("symbol", "ticker", "ticker symbol") if n in names)
    from tradelens.functions.columns import listing_symbol

    out = df.withColumn("symbol", listing_symbol(F.col(symbol)))
    cap = next((names[n] for n in ("marketcap", "market_cap", "market cap") if n in names), None)
    value = F.lit(0.0) if cap is None else F.coalesce(F.regexp_replace(F.col(cap).cast("string"), "[$,]", "").try_cast("double"), F.lit(0.0))
    out = out.withColumn("market_cap", value)
    if country is None:
        return out.where(F.col("symbol").rlike(r"^[A-Z]{1,5}(-[A-Z])?$"))
    return out.where(F.col("symbol").rlike(r"^[A-Z]{1,5}$") & (F.trim(F.col(names["country"])) == country) & (F.col("market_cap") > 0))


def write_universe(symbols: DataFrame, path: str) -> None:
    """The distinct symbols in order, one to a line, in one file: a list of tickers is small."""
    symbols.select(F.upper(F.trim("symbol")).alias("value")).where("value <> ''").distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def metric_rows(runs: DataFrame, field: str, schema: str) -> DataFrame:
    """Rows of one list in the JSON metrics of stored runs."""
    return runs.select("run_date", "threshold", "horizon_days", F.explode(F.from_json(F.get_json_object("metrics", f"$.{field}"), f"array<struct<{schema}>>")).alias("m")).select("run_date", "threshold", "horizon_days", "m.*")
