"""Ingest: filing index and documents to companies, filings, transactions and outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions.columns import short_cik
from tradelens.operators.dedup import in_universe, not_stored
from tradelens.sources import documents


@dataclass
class Ingested:
    filings: DataFrame
    companies: DataFrame
    transactions: DataFrame
    outcomes: DataFrame


def with_tickers(index: DataFrame, ciks: DataFrame) -> DataFrame:
    """Index records with the ticker of their company; companies without one get an empty ticker."""
    known = ciks.select(short_cik(F.col("cik")).alias("cik"), "ticker")
    return index.join(known, "cik", "left").withColumn("ticker", F.coalesce("ticker", F.lit("")))


def ingest(pages: list[DataFrame], ciks: DataFrame, docs: DataFrame, universe: DataFrame | None, stored: DataFrame) -> Ingested:
    """``pages``: index records of each form type; ``docs``: (accession_number, xml); ``stored``: known accession numbers.

    Records outside the universe and those that are stored fall away before their document is read; a
    record without a document has the outcome ``xml_missing``.
    """
    index = pages[0]
    for more in pages[1:]:
        index = index.unionByName(more)
    fresh = not_stored(in_universe(with_tickers(index, ciks), universe), stored, ["accession_number"]).dropDuplicates(["accession_number"])
    # records are short and hashed; documents stream past them, and are not sorted for the join
    found = documents.parsed(fresh.hint("shuffle_hash").join(docs, "accession_number", "left"))
    rows = documents.transactions(found)
    companies = rows.select("cik", "ticker", F.col("company").alias("name")).groupBy("cik").agg(F.max("ticker").alias("ticker"), F.max("name").alias("name"))
    filings = found.where("outcome = 'ok'").select("accession_number", "cik", "filed_date", "period_date", "form")
    return Ingested(filings, companies, rows, documents.outcomes(found))
