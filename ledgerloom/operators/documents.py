"""Reading fields from lines of documents: signals, labels, sections, blocks, agreement and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reading import paise

#: Signals of a bill, least number of them; least legible share and length of a document.
SIGNALS = (
    ("names itself a bill", r"(?i)\b(invoice|bill|receipt|challan)\b"), ("mentions tax", r"(?i)\b(GST|VAT|tax)\b"), ("mentions an amount", r"(?i)\b(total|amount|payable|due)\b"),
    ("names a tax identity", r"(?i)\b(GSTIN|PAN|TAN)\b"), ("prints a currency", r"(?i)₹|Rs\.?|INR"), ("carries a GSTIN", r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b"),
)
ENOUGH, LEGIBLE, LONG = 2, 0.5, 200
STATUSES = ("OCR_FAILED", "UNREADABLE", "UNKNOWN", "NON_INVOICE", "LOW_TEXT", "MISSING_FIELDS", "VALIDATION_FAILED", "READY")


def signals(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in SIGNALS]))


def status(docs: DataFrame) -> DataFrame:
    """``status`` of documents with text, share (legible), signals, missing (mandatory fields not read) and failed (laws).

    The first that holds stops the ladder. One signal of a bill is too few to say what a document is (UNKNOWN), none says that it is no bill.
    """
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return docs.withColumn("status", F.when(blank, "OCR_FAILED").when(F.col("share") < LEGIBLE, "UNREADABLE").when(F.size("signals") < ENOUGH, F.when(F.size("signals") > 0, "UNKNOWN").otherwise("NON_INVOICE")).when(F.length("text") < LONG, "LOW_TEXT").when(F.col("missing") > 0, "MISSING_FIELDS").when(F.col("failed") > 0, "VALIDATION_FAILED").otherwise("READY"))


def status_counts(docs: DataFrame) -> DataFrame:
    """Documents per status, those without any too."""
    every = docs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(docs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0)


def the_one(found: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key if all its printings agree; else null and how many there are."""
    per = found.groupBy(*keys).agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"))
    return per.withColumn("value", F.when(F.col("values") == 1, F.col("value")))


def label_amounts(lines: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """doc_id, line_no, label, value: the figure that a line prints behind a label it begins with, longest label first."""
    known = sorted(labels, key=lambda x: (-len(x), x))
    shape = r"(?i)^\s*({})\b[^0-9-]*(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*$".format("|".join(known))
    value = F.regexp_replace(F.regexp_extract("text", shape, 2), ",", "").try_cast("decimal(20,2)")
    return lines.filter(F.col("text").rlike(shape)).select("doc_id", "line_no", F.upper(F.regexp_extract("text", shape, 1)).alias("label"), (value * 100).cast("bigint").alias("value"))


def sections(lines: DataFrame, headings: dict[str, str]) -> DataFrame:
    """``section`` of each line: that of the last heading at or above it (null before the first)."""
    side = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(s)) for s, p in headings.items()])
    return lines.withColumn("section", F.last(side, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))


def block(lines: DataFrame, header: str, footer: str) -> DataFrame:
    """Lines inside the one block between a header and the next footer; a document with a second header has none."""
    own = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("doc_id")
    head, foot = F.col("text").rlike(header).cast("int"), F.col("text").rlike(footer).cast("int")
    rows = lines.withColumn("__h", F.sum(head).over(own)).withColumn("__is", head).withColumn("__all", F.sum(head).over(whole))
    rows = rows.withColumn("__f", F.sum(F.when(F.col("__h") > 0, foot).otherwise(0)).over(own))
    return rows.filter("__h = 1 AND __f = 0 AND __is = 0 AND __all = 1").drop("__h", "__f", "__is", "__all")


def itemised(lines: DataFrame, header: str, footer: str, item: str) -> DataFrame:
    """doc_id, items, why: the amounts (paise) of the one block between header and footer; null, with the reason, if it has none, two, or a row that can't be read.

    ``item`` is a pattern whose first group is the row's amount. Blank lines are skipped. Null is not an empty block: what wasn't itemised can't be added up.
    """
    heads = lines.groupBy("doc_id").agg(F.count_if(F.col("text").rlike(header)).alias("heads"))
    rows = block(lines, header, footer).filter(F.trim("text") != "")
    amount = paise(F.regexp_extract("text", item, 1))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", amount.alias("paise")))).alias("rows"), F.count_if(amount.isNull()).alias("bad"))
    own = heads.join(per, "doc_id", "left")
    why = F.when(F.col("heads") > 1, "more than one block").when((F.col("heads") == 0) | F.col("rows").isNull(), "no block").when(F.col("bad") > 0, "a row can't be read").otherwise("")
    return own.select("doc_id", F.when(why == "", F.transform("rows", lambda r: r["paise"])).alias("items"), why.alias("why"))
