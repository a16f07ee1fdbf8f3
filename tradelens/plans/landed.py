"""Named queries over landed files: yearly filings of each company, written below the shared folder and read from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.plans import registry
from tradelens.plans import views as V
from tradelens.plans.oracle import WITH
from tradelens.plans.shared import scratch
from tradelens.sources import documents, landing

#: Bytes from which on a file is set aside.
MOST_BYTES = 400_000


def _land(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files as they are scanned, and the document map.

    Among the filings are pages instead of XML (a second file has the XML), bytes that are no text,
    empty and oversized files, and filings that the map does not name. Files are landed in gzip, as the
    XML of all lines takes thirty times the space of the tables; rows are put in the order of the folders
    before their XML is made.
    """
    root = scratch(spark, "landed")
    keys = ["cik", "filed_year"]
    filings = registry.gathered(V.transactions(spark, d).withColumn("filed_year", F.year("transaction_date")), keys)
    k = F.col("cik").cast("long") + F.col("filed_year")
    kind = F.when(k % 11 == 0, "page").when(k % 13 == 0, "bytes").when(k % 17 == 0, "unnamed").when(k % 19 == 0, "empty").when(k % 23 == 0, "large").otherwise("plain")
    accession = F.concat(F.lpad("cik", 10, "0"), F.lit("-"), F.lpad((F.col("filed_year") % 100).cast("string"), 2, "0"), F.lit("-000001"))
    filings = filings.select("cik", "owner", "lines", accession.alias("accession"), kind.alias("kind"))
    files = F.when(F.col("kind") == "page", F.array(F.lit("form5.xml"), F.lit("data.xml"))).otherwise(F.array(F.lit("form5.xml")))
    each = filings.select(F.coalesce(landing.plain_accession(F.col("accession")), F.lit("")).alias("accession_number"), F.explode(files).alias("document"), "kind", "cik", "owner", "lines")
    bad = F.unhex(F.lit("FFFE3C00")).cast("string")
    first, xml = F.col("document") == "form5.xml", registry.filing_xml()
    text = F.when(first & (F.col("kind") == "page"), "<html>a rendered page</html>").when(F.col("kind") == "bytes", bad).when(F.col("kind") == "empty", "").when(F.col("kind") == "large", F.concat("xml", F.repeat(F.lit(" "), MOST_BYTES))).otherwise(F.col("xml"))
    each = each.sortWithinPartitions("accession_number", "document").withColumn("xml", xml).select(text.alias("text"), "accession_number", "document")
    landing.write_files(each, f"{root}/files")
    names = V.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("cik"), F.year(F.to_date("l_shipdate")).alias("filed_year"))
    listed = F.struct(F.col("accession").alias("a"), F.when(kind == "unnamed", "").otherwise("xslF345X05/form5.xml").alias("p"))
    names = names.distinct().withColumn("accession", accession).groupBy("cik").agg(F.collect_list(listed).alias("n"))
    names.select("cik", F.col("n.a").alias("accessionNumber"), F.col("n.p").alias("primaryDocument")).write.json(f"{root}/listings")
    return landing.scan_files(spark, f"{root}/files", MOST_BYTES), landing.read_document_map(spark, f"{root}/listings")


def landed_documents(spark, d):
    """The document of each filing, how it was found, and what the parser says of it."""
    found = documents.parsed(landing.filing_documents(*_land(spark, d)))
    lines = F.coalesce(F.size("doc.nonDerivativeTable.nonDerivativeTransaction"), F.lit(0))
    return found.select("accession_number", "document", "via", "outcome", F.greatest(lines, F.lit(0)).alias("n_lines"))


def landed_transactions(spark, d):
    """Lines of the landed documents, by company and code."""
    rows = documents.transactions(documents.parsed(landing.filing_documents(*_land(spark, d))))
    return rows.groupBy("ticker", "transaction_code").agg(F.count("*").alias("n"), F.sum("shares").cast("long").alias("shares"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"))


def files_set_aside(spark, d):
    """Files that cannot be read."""
    return landing.set_aside(_land(spark, d)[0]).select("accession_number", "document", "status")


NAMES = [landed_documents, landed_transactions, files_set_aside]

_FILES = f"""{WITH}, k AS (SELECT tx.*, CAST(cik AS BIGINT) + year(transaction_date) AS k FROM tx), f AS (
  SELECT *, lpad(cik, 10, '0') || lpad(CAST(year(transaction_date) % 100 AS VARCHAR), 2, '0') || '000001' AS accession_number,
    CASE WHEN k % 11 = 0 THEN 'page' WHEN k % 13 = 0 THEN 'bytes' WHEN k % 17 = 0 THEN 'unnamed' WHEN k % 19 = 0 THEN 'empty' WHEN k % 23 = 0 THEN 'large' ELSE 'plain' END AS kind FROM k
), g AS (SELECT *, kind IN ('page', 'unnamed', 'plain') AS good FROM f)"""
ORACLE_LANDED = {
    "landed_documents": f"""{_FILES} SELECT accession_number, CASE WHEN good THEN CASE kind WHEN 'page' THEN 'data.xml' ELSE 'form5.xml' END END AS document, CASE WHEN good THEN CASE kind WHEN 'plain' THEN 'primary' ELSE 'index' END END AS via,
  CASE WHEN good THEN 'ok' ELSE 'xml_missing' END AS outcome, CAST(CASE WHEN good THEN count(*) ELSE 0 END AS INTEGER) AS n_lines FROM g GROUP BY accession_number, kind, good""",
    "landed_transactions": f"{_FILES} SELECT 'T' || cik AS ticker, transaction_code, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares, min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM g WHERE good GROUP BY cik, transaction_code",
    "files_set_aside": f"{_FILES} SELECT DISTINCT accession_number, 'form5.xml' AS document, CASE kind WHEN 'bytes' THEN 'not_text' WHEN 'empty' THEN 'empty' ELSE 'too_large' END AS status FROM g WHERE NOT good",
}
