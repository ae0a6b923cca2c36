"""News, filing indexes and insider forms as tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import owner_role, parse_number, strip_xml_namespaces

C = F.col
SALE_CODES = ("S", "S-")
#: What a document with a sale code has somewhere: the code as a text of its own, or signs that can stand for it.
_MAY_SELL = r"[>\s]S-?\s*<|&|<!\[CDATA\["
INDEX = "form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>"
_VALUE = "struct<value:string>"
FORM4 = (
    "reportingOwner struct<reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VALUE}>>>>"
)


def normalize_news(df: DataFrame) -> DataFrame:
    """headline, created_at (UTC; rows with a bad one go), source, and one row per symbol of the list."""
    rows = df.withColumn("created_at", F.try_to_timestamp(C("created_at").cast("string"))).na.drop(subset=["created_at"])
    return rows.select("headline", "created_at", "source", F.explode("symbols").alias("symbol"))


def join_symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("symbols", F.array_join("symbols", ","))


def explode_filing_index(df: DataFrame, start: dt.date, end: dt.date, form: str = "4", json: str = "json") -> DataFrame:
    """Rows of the parallel arrays of filing indexes, of one form and within the dates."""
    rows = df.withColumn("_i", F.from_json(C(json), INDEX)).select(*[c for c in df.columns if c != json], F.inline(F.arrays_zip("_i.form", "_i.filingDate", "_i.accessionNumber", "_i.primaryDocument")))
    rows = rows.withColumn("filing_date", C("filingDate").try_cast("date")).filter((C("form") == form) & C("filing_date").between(F.lit(start), F.lit(end)))
    return rows.drop("filingDate").withColumnsRenamed({"accessionNumber": "accession", "primaryDocument": "document"})


def symbol_to_cik(df: DataFrame, json: str = "json") -> DataFrame:
    """(symbol, cik) of a JSON object of {ticker, cik_str} entries."""
    entries = F.from_json(C(json), "map<string,struct<ticker:string,cik_str:bigint>>")
    return df.select(F.explode(entries).alias("k", "v")).select(F.upper("v.ticker").alias("symbol"), C("v.cik_str").alias("cik"))


def parse_form4(df: DataFrame) -> DataFrame:
    """(symbol, xml, filing_date) -> one row per sale: trade_date, filing_date, role, transaction_type, shares_sold_pct.

    The share sold is sold / (left + sold), 6 digits. Rows with bad share counts go, a bad trade date becomes the filing date,
    and malformed documents give no rows.
    """
    df = df.filter(C("xml").rlike(_MAY_SELL))  # others have no sale, so they aren't parsed
    doc = F.from_xml(strip_xml_namespaces(C("xml")), FORM4, {"rowTag": "ownershipDocument"})
    owner = C("d.reportingOwner.reportingOwnerRelationship")
    rows = df.withColumn("d", doc).select("symbol", "filing_date", owner_role(owner["officerTitle"], owner["isDirector"], owner["isOfficer"]).alias("role"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    sold, left = parse_number(C("t.transactionAmounts.transactionShares.value")), parse_number(C("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value"))
    rows = rows.filter(F.trim("t.transactionCoding.transactionCode").isin(*SALE_CODES) & (F.coalesce(F.trim("t.transactionAmounts.transactionAcquiredDisposedCode.value"), F.lit("D")) == "D"))
    rows = rows.withColumns({"_sold": sold, "_left": left}).filter((C("_sold") > 0) & (C("_left") + C("_sold") > 0))
    return rows.select(
        "symbol",
        F.coalesce(F.substring("t.transactionDate.value", 1, 10).try_cast("date"), C("filing_date")).alias("trade_date"),
        "filing_date",
        "role",
        F.trim("t.transactionCoding.transactionCode").alias("transaction_type"),
        F.round(C("_sold") / (C("_left") + C("_sold")), 6).alias("shares_sold_pct"),
    )
