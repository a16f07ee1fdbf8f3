"""Filing documents to rows: one native parse per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions import columns as C

VALUE = "struct<value:string>"
LINE = (
    f"struct<transactionDate:{VALUE},transactionCoding:struct<transactionFormType:string,transactionCode:string,transactionTimeliness:string>,"
    f"transactionAmounts:struct<transactionShares:{VALUE},transactionPricePerShare:{VALUE},transactionAcquiredDisposedCode:{VALUE}>,"
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{VALUE}>,ownershipNature:struct<directOrIndirectOwnership:{VALUE}>>"
)
DOCUMENT = (
    "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>,"
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string>>>,"
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<{LINE}>>,derivativeTable struct<derivativeTransaction:array<struct<securityTitle:{VALUE}>>>,_corrupt string"
)


def parsed(documents: DataFrame) -> DataFrame:
    """Add ``doc`` and ``outcome``: ok, deriv_only, xml_missing or parse_error.

    The parsed document passes through a generator, so that no filter or projection above repeats the parse.
    """
    one = F.from_xml("xml", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": "ownershipDocument", "excludeAttribute": "true"})
    out = documents.withColumn("doc", F.explode(F.array(one)))
    lines = F.coalesce(F.size("doc.nonDerivativeTable.nonDerivativeTransaction"), F.lit(0))
    outcome = F.when(F.coalesce(F.trim("xml"), F.lit("")) == "", "xml_missing").when(F.col("doc._corrupt").isNotNull() | F.col("doc.issuer").isNull(), "parse_error").when(lines <= 0, "deriv_only").otherwise("ok")
    return out.withColumn("outcome", outcome)


def outcomes(found: DataFrame) -> DataFrame:
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


def _coding_flag(name: str) -> Column:
    """A yes-or-no field of a line's coding, written plainly or in a value element."""
    return C.flag(F.trim(F.regexp_replace(F.col(f"t.transactionCoding.{name}"), "<[^>]*>", "")))


def transactions(found: DataFrame) -> DataFrame:
    """One row per line of Table I, under the first reporting owner."""
    owner = F.try_element_at("doc.reportingOwner", F.lit(1))
    rel = owner["reportingOwnerRelationship"]
    head = found.where("outcome = 'ok'").select(
        "accession_number",
        C.short_cik(F.trim("doc.issuer.issuerCik")).alias("cik"),
        C.clean_ticker(F.col("doc.issuer.issuerTradingSymbol")).alias("ticker"),
        F.trim("doc.issuer.issuerName").alias("company"),
        F.trim(owner["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"),
        C.title_or_director(rel["officerTitle"], C.flag(rel["isDirector"])).alias("insider_role"),
        C.names_plan(F.col("xml")).alias("_plan"),
        F.explode("doc.nonDerivativeTable.nonDerivativeTransaction").alias("t"),
    )
    shares, price = C.number(F.col("t.transactionAmounts.transactionShares.value")), C.number(F.col("t.transactionAmounts.transactionPricePerShare.value"))
    code = F.upper(F.trim("t.transactionCoding.transactionCode"))
    return head.select(
        "accession_number", "cik", "ticker", "company", "insider_name", "insider_role",
        C.role_category(F.col("insider_role")).alias("role_category"),
        C.date_prefix(F.col("t.transactionDate.value")).alias("transaction_date"),
        code.alias("transaction_code"),
        shares.alias("shares"),
        price.alias("price_per_share"),
        C.total_value(shares, price, code).cast("decimal(20,4)").alias("total_value"),
        C.number(F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value")).alias("shares_after"),
        (F.col("_plan") | _coding_flag("transactionFormType") | _coding_flag("transactionTimeliness")).alias("is_10b51"),
        C.is_direct(F.trim("t.ownershipNature.directOrIndirectOwnership.value")).alias("is_direct"),
        F.coalesce(F.nullif(F.trim("t.transactionAmounts.transactionAcquiredDisposedCode.value"), F.lit("")), F.lit("A")).alias("acquired_disposed"),
    )
