"""Queries that read dates, amounts and fields out of printed bills, with SQL that knows what was printed.

Bills are printed from orders and their line items in several manners (labels, layouts, repeats, contradictions); the SQL derives what has to be read from
the order itself and never parses the print.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import reading as R
from ..operators import fields as P
from ..shared import kept
from . import views as V


def _printed(paise: Column) -> Column:
    return F.concat(F.call_function("div", paise, F.lit(100)).cast("string"), F.lit("."), F.lpad((paise % 100).cast("string"), 2, "0"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, day, buyer, net, half, grand, items (printed, in order): an order as a bill."""
    line, orders = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "orders")
    line = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.paise(F.col("l_extendedprice")).alias("a"), F.col("l_quantity").cast("bigint").alias("count"))
    said = F.concat_ws(" ", F.lit("Part"), F.col("l_partkey").cast("string"), F.col("count").cast("string"), _printed(F.call_function("div", F.col("a"), F.col("count"))), _printed(F.col("a")))
    line = line.select(F.col("l_orderkey").alias("doc_id"), "a", F.struct("l_linenumber", "l_partkey", "l_suppkey", "a", said.alias("said")).alias("item"))  # worked out before they are gathered, which isn't compiled
    per = line.groupBy("doc_id").agg(F.sum("a").alias("net"), F.transform(F.array_sort(F.collect_list("item")), lambda x: x["said"]).alias("items"))
    own = orders.select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").cast("string").alias("buyer"))
    half = F.expr("net * 9 div 100")
    return own.join(per, "doc_id").withColumn("half", half).withColumn("grand", F.col("net") + 2 * half)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text of each bill."""
    o, c = F.col("doc_id"), F.col("buyer")
    day = F.when(o % 4 == 0, F.date_format("day", "dd/MM/yyyy")).when(o % 4 == 1, F.date_format("day", "dd MMM yyyy")).when(o % 4 == 2, F.date_format("day", "yyyy-MM-dd")).otherwise("31/02/2026")
    party = F.when(o % 5 == 0, F.concat(F.lit("VENDOR: Acme Traders "), c)).when(o % 5 == 1, F.concat(F.lit("Sold By : Acme Traders "), c)).when(o % 5 == 2, "VENDOR: eTvan42").when(o % 5 == 3, F.concat(F.lit("Acme Traders "), c)).otherwise(F.concat(F.lit("SUPPLIER: Left "), c))
    net, half, tax, grand = (_printed(x) for x in (F.col("net"), F.col("half"), 2 * F.col("half"), F.col("grand")))
    head = [
        F.concat(F.lit("TAX INVOICE NO: INV-"), o.cast("string"), F.when(o % 7 == 0, "").otherwise(F.concat(F.lit("   DATE: "), day))), party, F.lit("BILL TO"), F.concat(F.lit("Someone "), c),
        F.when(o % 2 == 0, "29ABCDE1234F1Z5").otherwise("no registration"), F.when(o % 5 == 4, F.concat(F.lit("VENDOR: Right "), c)).otherwise(""), F.when(o % 7 == 0, "Printed on 03/11/2025").otherwise(""), F.lit("DESCRIPTION QTY RATE AMOUNT"),
    ]
    foot = [
        F.concat(F.lit("SUB TOTAL: "), net), F.when(o % 3 == 1, F.concat(F.lit("TAX: "), tax)).otherwise(F.concat(F.lit("CGST @ 9%: "), half)), F.when(o % 3 == 0, F.concat(F.lit("SGST : Rs. "), half)).when(o % 3 == 2, F.concat(F.lit("TAX: "), tax)).otherwise(""),
        F.when(o % 4 == 1, "TOTAL").when(o % 4 == 3, "TOTAL QUANTITY").otherwise(F.concat(F.lit("Total: "), grand)), F.when(o % 4 == 0, F.concat(F.lit("TOTAL: "), grand, F.lit("/-"))).when(o % 4 == 1, grand).when(o % 4 == 2, F.concat(F.lit("GRAND TOTAL: "), _printed(F.col("grand") + 1))).otherwise("012"),
    ]
    return bills(spark, sf_dir).select("doc_id", F.posexplode(F.concat(F.array(*head), "items", F.array(*foot))).alias("line_no", "text"))


BILLS = """
WITH s AS (SELECT l_orderkey AS o, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS net, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT o, CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderdate AS DATE) AS d, net, net * 9 // 100 AS half, net + 2 * (net * 9 // 100) AS grand, n FROM s JOIN orders ON o_orderkey = o),
bills AS (SELECT *, CASE o % 4 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%d %b %Y') WHEN 2 THEN strftime(d, '%Y-%m-%d') ELSE '31/02/2026' END AS day, CASE WHEN o % 4 = 3 THEN NULL ELSE CAST(d AS VARCHAR) END AS read_day FROM b)"""


# Single values


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = (
        F.when(o % 8 == 0, F.concat(F.lit("Date: "), F.date_format(d, "dd/MM/yyyy"))).when(o % 8 == 1, F.date_format(d, "yyyy-MM-dd")).when(o % 8 == 2, F.date_format(d, "d MMMM yyyy")).when(o % 8 == 3, F.date_format(d, "dd-MM-yy"))
        .when(o % 8 == 4, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" (page 2: "), F.date_format(d, "dd/MM/yyyy"), F.lit(")"))).when(o % 8 == 5, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" to "), F.date_format(F.date_add(d, 1), "yyyy-MM-dd"))).when(o % 8 == 6, F.concat(F.lit("Version 1.2.34 of "), o.cast("string")))
        .otherwise(F.concat(F.lit("30/02/"), F.date_format(d, "yyyy")))
    )
    return V.table(spark, sf_dir, "orders").select(o.alias("id"), text.alias("text"))


def fn_read_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _dates(spark, sf_dir).select("id", R.date(F.col("text"), R.DAY_FIRST).alias("a"), R.date(F.col("text"), R.EITHER).alias("b"))
    return own.select("id", F.col("a.value").cast("string").alias("day_first"), F.col("a.why").alias("why"), F.col("b.value").cast("string").alias("either"), F.col("b.ambiguous").alias("ambiguous"))


register("fn_read_date", fn_read_date, """
WITH t AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS two FROM orders),
u AS (SELECT *, CASE WHEN k = 3 THEN make_date(CASE WHEN year(d) % 100 <= 68 THEN 2000 ELSE 1900 END + year(d) % 100, month(d), day(d)) ELSE d END AS e FROM t)
SELECT id, CASE WHEN k <= 4 THEN CAST(e AS VARCHAR) END AS day_first, CASE WHEN k <= 4 THEN '' WHEN k = 5 THEN 'several dates' WHEN k = 6 THEN 'no date' ELSE 'no such day' END AS why,
  CASE WHEN k IN (1, 2) OR k IN (0, 3, 4) AND NOT two THEN CAST(e AS VARCHAR) END AS either, k IN (0, 3, 4) AND two AS ambiguous FROM u""")


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in several currencies and manners, of order totals."""
    o, p = F.col("o_orderkey"), V.paise(F.col("o_totalprice"))
    comma, whole = F.format_number(p / 100, 2), F.call_function("div", p, F.lit(100)).cast("string")
    text = (
        F.when(o % 8 == 0, F.concat(F.lit("Total Rs. "), comma)).when(o % 8 == 1, F.concat(F.translate(comma, ",.", ".,"), F.lit(" €"))).when(o % 8 == 2, F.concat(F.lit("$"), _printed(p))).when(o % 8 == 3, F.concat(F.lit("JPY "), whole))
        .when(o % 8 == 4, F.concat(F.lit("GST @ 18% INR "), comma)).when(o % 8 == 5, F.concat(F.lit("$"), _printed(p), F.lit(" (USD)"))).when(o % 8 == 6, F.concat(F.lit("GBP "), _printed(p), F.lit(" or 1.00"))).otherwise(F.concat(F.lit("IDR "), _printed(p)))
    )
    return V.table(spark, sf_dir, "orders").select(o.alias("id"), text.alias("text"))


register("fn_money_any", lambda s, d: _amounts(s, d).select("id", R.money(F.col("text")).alias("m")).select("id", "m.minor", "m.code", "m.ambiguous", "m.why"), """
WITH t AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders)
SELECT id, CASE WHEN k IN (0, 1, 2, 4, 5) THEN p WHEN k = 3 THEN p // 100 END AS minor, (['INR', 'EUR', 'UNKNOWN', 'JPY', 'INR', 'USD', 'UNKNOWN', 'IDR'])[k + 1] AS code, k IN (2, 6, 7) AS ambiguous,
  CASE k WHEN 2 THEN 'currency is not stated' WHEN 6 THEN 'several amounts' WHEN 7 THEN 'finer than the minor unit' ELSE '' END AS why FROM t""")
register("fn_paise", lambda s, d: V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), R.paise(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Rs. ").when(F.col("o_orderkey") % 3 == 1, "₹").otherwise(""), F.format_number(F.col("o_totalprice"), 2), F.when(F.col("o_orderkey") % 5 == 0, "5").when(F.col("o_orderkey") % 5 == 1, " GBP").when(F.col("o_orderkey") % 5 == 2, "/-").otherwise(""))).alias("paise")), """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 2) THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS paise FROM orders""")


def fn_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 6, F.regexp_replace("s_name", "[^A-Za-z]", "")
    text = F.when(k == 0, F.concat(F.lit("|"), name)).when(k == 1, F.concat(name, F.lit("4x2"))).when(k == 2, "x.").when(k == 3, F.concat(name, F.lit(" bcdfghjkl"))).when(k == 4, F.concat(name, F.lit(" aBaB"))).otherwise(name)
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(R.artifacts(text), ",").alias("said"))


register("fn_artifact", fn_artifact, "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'furniture' WHEN 1 THEN 'mixed' WHEN 2 THEN 'short' WHEN 4 THEN 'case' ELSE '' END AS said FROM supplier")


def fn_not_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = F.col("o_orderkey"), V.paise(F.col("o_totalprice"))
    k = o % 9
    value = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, "18").when(k == 2, (o % 50).cast("string")).when(k == 3, "998311").when(k == 4, F.concat(F.lit("98"), F.lpad((o % 100_000_000).cast("string"), 8, "0"))).when(k == 5, F.concat(F.lit("4"), F.lpad((o % 100_000).cast("string"), 5, "0"))).when(k == 6, F.concat(F.lit("INV-"), o.cast("string"))).when(k == 7, F.concat(_printed(p), F.lit("5"))).otherwise(F.concat(F.lit("Rs. "), _printed(p)))
    context = F.when(k == 1, "GST 18 %").when(k == 2, "Total Qty").when(k == 3, "HSN/SAC: 998311").otherwise("Total")
    return V.table(spark, sf_dir, "orders").select(o.alias("id"), R.not_money(value, context).alias("why"))


register("fn_not_money", fn_not_money, "SELECT o_orderkey AS id, (['a date', 'a percentage', 'a quantity', 'a classification code', 'a phone number', 'a postal code', 'a document number', 'a malformed amount', ''])[o_orderkey % 9 + 1] AS why FROM orders")


# Labels and figures near them

register("jn_label_values", lambda s, d: P.label_values(pages(s, d)), BILLS + """
SELECT o AS doc_id, 'number' AS field, unnest([0, 2]) AS label_no, 0 AS line_no, 'INV-' || o AS value FROM bills UNION ALL SELECT o, 'date', 0, 0, day FROM bills WHERE o % 7 <> 0
UNION ALL SELECT o, 'party', CASE WHEN o % 5 = 1 THEN 3 WHEN o % 5 = 4 THEN 0 ELSE 1 END, 1, CASE o % 5 WHEN 2 THEN 'eTvan42' WHEN 4 THEN 'Left ' || c ELSE 'Acme Traders ' || c END FROM bills WHERE o % 5 <> 3
UNION ALL SELECT o, 'party', 1, 5, 'Right ' || c FROM bills WHERE o % 5 = 4""")


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three lines an order: a figure on, below, above or beside a label."""
    o, g = F.col("o_orderkey"), _printed(V.paise(F.col("o_totalprice")))
    k = o % 7
    said = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in ("Thank you", *xs)])
    lines = (
        F.when(k == 0, said(F.concat(F.lit("TOTAL: "), g))).when(k == 1, said("TOTAL", g)).when(k == 2, said(g, "Total")).when(k == 3, said(F.concat(F.lit("SUB TOTAL "), g))).when(k == 4, said("TOTAL QUANTITY 12", g))
        .when(k == 5, said(F.concat(F.lit("GRAND TOTAL Rs. "), g), "10.00")).otherwise(said("TOTAL", F.concat(g, F.lit(" 10.00"))))
    )
    return V.table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))


_FIGURES = """
WITH t AS (SELECT o_orderkey AS o, o_orderkey % 7 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders), g AS (SELECT *, (p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS g FROM t),
n AS (
  SELECT o AS doc_id, CASE WHEN k = 3 THEN 'net' ELSE 'total' END AS field, CASE k WHEN 0 THEN 'TOTAL:' WHEN 2 THEN 'Total' WHEN 3 THEN 'SUB TOTAL' WHEN 5 THEN 'GRAND TOTAL' ELSE 'TOTAL' END AS label, CASE WHEN k = 5 THEN 'Rs. ' || g WHEN k = 4 THEN '12' ELSE g END AS value,
    CASE k WHEN 0 THEN 'same_line' WHEN 1 THEN 'next_line' WHEN 2 THEN 'previous_line' WHEN 6 THEN 'next_line' ELSE 'same_line' END AS method, CASE WHEN k = 4 THEN 'a quantity' ELSE '' END AS rejected, CASE WHEN k = 6 AND g > '10.00' THEN 2 ELSE 1 END AS rank FROM g
  UNION ALL SELECT o, 'total', 'TOTAL', g, 'next_line', 'a quantity', 2 FROM g WHERE k = 4 UNION ALL SELECT o, 'total', 'GRAND TOTAL', '10.00', 'next_line', '', 2 FROM g WHERE k = 5
  UNION ALL SELECT o, 'total', 'TOTAL', '10.00', 'next_line', '', CASE WHEN g > '10.00' THEN 1 ELSE 2 END FROM g WHERE k = 6)"""
register("jn_nearby", lambda s, d: P.nearby(_figures(s, d)).select("doc_id", "field", "label", "value", "method", "rejected", "rank"), _FIGURES + " SELECT * FROM n")
register("win_candidates", lambda s, d: P.review(P.nearby(_figures(s, d))), _FIGURES + " SELECT doc_id, field, count(*) AS accepted, arg_min(value, rank) AS value, count(DISTINCT value) > 1 AND min(method) = max(method) AS review FROM n WHERE rejected = '' GROUP BY 1, 2")

# Pages

_FIELDS = BILLS + """,
fields AS (
  SELECT o AS doc_id, 'number' AS field, 'INV-' || o AS value, 1.0 AS confidence FROM bills
  UNION ALL SELECT o, 'date', CASE WHEN o % 7 = 0 THEN '2025-11-03' ELSE read_day END, CASE WHEN o % 7 = 0 THEN 0.5 ELSE 1.0 END FROM bills WHERE o % 7 = 0 OR read_day IS NOT NULL
  UNION ALL SELECT o, 'party', CASE WHEN o % 5 = 2 THEN 'eTvan42' ELSE 'Acme Traders ' || c END, CASE WHEN o % 5 = 2 THEN 0.0 ELSE 1.0 END FROM bills WHERE o % 5 < 3
  UNION ALL SELECT o, 'net', CAST(net AS VARCHAR), 1.0 FROM bills UNION ALL SELECT o, 'tax', CAST(2 * half AS VARCHAR), 1.0 FROM bills WHERE o % 3 <> 0
  UNION ALL SELECT o, 'total', CAST(grand AS VARCHAR), CASE WHEN o % 4 = 0 THEN 1.0 ELSE 0.5 END FROM bills WHERE o % 4 < 2)"""
register("agg_page_fields", lambda s, d: P.page_fields(pages(s, d)), _FIELDS + " SELECT doc_id, field, value, confidence::DOUBLE AS confidence FROM fields")


def agg_doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.confidence(P.page_fields(pages(spark, sf_dir)))
    return found.select("doc_id", F.round("average", 6).alias("average"), "lowest", F.array_join("fields", ",").alias("fields"))


register("agg_doc_confidence", agg_doc_confidence, _FIELDS + " SELECT doc_id, round(avg(confidence) FILTER (confidence > 0), 6)::DOUBLE AS average, min(confidence) FILTER (confidence > 0)::DOUBLE AS lowest, string_agg(field, ',' ORDER BY field) FILTER (confidence > 0) AS fields FROM fields GROUP BY 1")
register("agg_split_tax", lambda s, d: P.split_tax(pages(s, d)), BILLS + " SELECT o AS doc_id, CASE WHEN o % 3 < 2 THEN 2 * half END AS tax FROM bills")
register("win_head_party", lambda s, d: P.head_dates(pages(s, d)).select("doc_id", "printed", "line_no"), BILLS + " SELECT o AS doc_id, CASE WHEN o % 7 = 0 THEN '03/11/2025' ELSE day END AS printed, CASE WHEN o % 7 = 0 THEN 6 ELSE 0 END AS line_no FROM bills")
register("win_below_heading", lambda s, d: P.below_heading(pages(s, d), "buyer"), BILLS + " SELECT o AS doc_id, 'Someone ' || c AS value FROM bills")


def agg_doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = P.doc_fields(pages(spark, sf_dir))
    rest = ("po", "irn", "eway", "place", "supplier_tax_id", "supplier_state", "supplier_address", "buyer_address", "igst", "cess", "round_off", "words")
    return wide.select("doc_id", "number", "date", "supplier_name", "buyer_name", "buyer_tax_id", "buyer_state", "net", "cgst", "sgst", "tax", "total", "tax_stated", *rest, F.array_join("missing", ",").alias("missing"))


register("agg_doc_fields", agg_doc_fields, BILLS + """,
w AS (SELECT o AS doc_id, 'INV-' || o AS number, CASE WHEN o % 7 <> 0 THEN read_day END AS date, CASE WHEN o % 5 < 2 THEN 'Acme Traders ' || c WHEN o % 5 = 2 THEN 'eTvan42' END AS supplier_name, 'Someone ' || c AS buyer_name,
    CASE WHEN o % 2 = 0 THEN '29ABCDE1234F1Z5' END AS buyer_tax_id, CASE WHEN o % 2 = 0 THEN '29' END AS buyer_state, CAST(net AS VARCHAR) AS net, CASE WHEN o % 3 <> 1 THEN CAST(half AS VARCHAR) END AS cgst, CASE WHEN o % 3 = 0 THEN CAST(half AS VARCHAR) END AS sgst,
    CAST(2 * half AS VARCHAR) AS tax, CASE WHEN o % 4 = 0 THEN CAST(grand AS VARCHAR) END AS total, o % 3 <> 0 AS tax_stated,
    """ + ", ".join(f"CAST(NULL AS VARCHAR) AS {f}" for f in ("po", "irn", "eway", "place", "supplier_tax_id", "supplier_state", "supplier_address", "buyer_address", "igst", "cess", "round_off", "words")) + """ FROM bills)
SELECT *, concat_ws(',', CASE WHEN date IS NULL THEN 'date' END, CASE WHEN supplier_name IS NULL THEN 'supplier_name' END, CASE WHEN total IS NULL THEN 'total' END) AS missing FROM w""")


def win_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table_rows(pages(spark, sf_dir)).select("doc_id", "line_no", F.inline("cells"))
    rows = rows.withColumn("value", P.cell_value(F.col("column"), F.col("printed")))
    return rows.groupBy("doc_id").agg(F.count_distinct("line_no").alias("rows"), F.sum(F.when(F.col("column") == "line_total", F.col("value").cast("bigint"))).alias("total"), F.sum(F.when(F.col("column") == "quantity", F.col("value").cast("bigint"))).alias("quantity"), F.min(F.when(F.col("column") == "description", F.col("value"))).alias("first"))


register("win_table_rows", win_table_rows, """
SELECT l_orderkey AS doc_id, count(*) AS rows, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS total, sum(CAST(l_quantity AS BIGINT) * 1000)::BIGINT AS quantity, min('Part ' || l_partkey) AS first FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")


def fn_merge_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the bills: the characters read some fields, the picture others, and some both."""
    found = kept(P.page_fields(pages(spark, sf_dir)))  # read by both
    exact = found.filter("doc_id % 3 <> 0 OR field = 'number'").withColumn("source", F.lit("characters"))
    picture = found.filter("field <> 'net'").select("doc_id", "field", F.concat(F.lit("~"), "value").alias("value"), (F.col("confidence") / 2).alias("confidence"), F.lit("picture").alias("source"))
    return P.merged(exact, picture)


register("fn_merge_readings", fn_merge_readings, _FIELDS + """
SELECT doc_id, field, CASE WHEN doc_id % 3 <> 0 OR field = 'number' THEN value ELSE '~' || value END AS value, CASE WHEN doc_id % 3 <> 0 OR field = 'number' THEN 'characters' ELSE 'picture' END AS source,
  (CASE WHEN doc_id % 3 <> 0 OR field = 'number' THEN confidence ELSE confidence / 2 END)::DOUBLE AS confidence FROM fields WHERE doc_id % 3 <> 0 OR field <> 'net'""")
