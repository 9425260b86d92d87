"""Checks of single vouchers and laws of bills, each with its own verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: name -> whether a voucher passes; ``debit_known`` and ``credit_known`` say if the chart has the leg. A plug-in adds to it.
CHECKS: dict[str, Callable[[], Column]] = {
    "amount_is_positive": lambda: c("amount_paise") > 0,
    "amount_is_integer_paise": lambda: c("amount_paise").isNotNull(),
    "accounts_differ": lambda: (c("debit_account") == "") | (c("credit_account") == "") | (c("debit_account") != c("credit_account")),
    "accounts_exist": lambda: ((c("debit_account") == "") | c("debit_known")) & ((c("credit_account") == "") | c("credit_known")),
    "funding_is_named": lambda: c("credit_account") != "",
    "gst_not_larger_than_amount": lambda: F.coalesce(c("gst_paise"), F.lit(0)) <= c("amount_paise"),
    "tax_lines_can_be_posted": lambda: c("gst_paise").isNull(),
    "party_is_named": lambda: F.trim("party") != "",
}
#: Checks that no answer can mend.
UNANSWERABLE = ("amount_is_integer_paise", "tax_lines_can_be_posted")


def with_chart(rows: DataFrame, chart: DataFrame) -> DataFrame:
    known = chart.select("company_key", F.col("account"), F.lit(True).alias("__known")).distinct()
    for side in ("debit", "credit"):
        rows = rows.join(known.withColumnRenamed("account", f"{side}_account").withColumnRenamed("__known", f"{side}_known"), ["company_key", f"{side}_account"], "left")
        rows = rows.withColumn(f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
    return rows


def checked(rows: DataFrame, chart: DataFrame) -> DataFrame:
    """``checks``: array of (name, passed), every check of every voucher, always all. Absent legs count as unnamed."""
    rows = with_chart(rows.fillna({"debit_account": "", "credit_account": "", "party": ""}), chart)
    return rows.withColumn("checks", F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(f(), F.lit(False)).alias("passed")) for n, f in CHECKS.items()])).drop("debit_known", "credit_known")


def run(rows: DataFrame, chart: DataFrame) -> DataFrame:
    """company_key, id, name, passed: the checks in long form."""
    return checked(rows, chart).select("company_key", "id", F.inline("checks"))


def law(left: Column, right: Column) -> Column:
    """PASS or FAIL by exact equality; INDETERMINATE if either side is unknown."""
    return F.when(left.isNull() | right.isNull(), "INDETERMINATE").when(left == right, "PASS").otherwise("FAIL")


def conservation(rows: DataFrame) -> DataFrame:
    """id, law, verdict: debits = credits, lines sum to the total, net + tax = gross, balance moves by the entry.

    Columns: debits, credits, lines (array, null: unknown, empty: none), total, net, tax, gross, before, after, entry.
    """
    lines = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x)
    verdicts = (("debits_equal_credits", law(c("debits"), c("credits"))), ("lines_sum_to_total", law(lines, c("total"))), ("net_plus_tax_is_gross", law(c("net") + c("tax"), c("gross"))), ("balance_moves_by_entry", law(c("after") - c("before"), c("entry"))))
    return rows.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("law"), v.alias("verdict")) for n, v in verdicts])))


def applicable(findings: DataFrame, kinds: tuple[str, ...] = ("invoice", "credit_note")) -> DataFrame:
    """What can't be told about a document of another kind doesn't apply to it; what was told stays."""
    return findings.withColumn("verdict", F.when((F.col("verdict") == "INDETERMINATE") & ~F.col("kind").isin(*kinds), "NOT_APPLICABLE").otherwise(F.col("verdict")))


def within(left: Column, right: Column, tolerance: int) -> Column:
    return F.when(left.isNull() | right.isNull(), "INDETERMINATE").when(F.abs(left - right) <= tolerance, "PASS").otherwise("FAIL")


def bill_laws(bills: DataFrame, lines: DataFrame, tolerance: int = 100) -> DataFrame:
    """doc, law, verdict, out_by: line arithmetic per line, then the sums of a bill.

    lines: doc, line_no, quantity_milli, rate_paise, discount_paise (null: none), taxable_paise. bills: doc, taxable_paise, cgst, sgst,
    igst, tax_paise, tax_stated, round_off, grand_paise, number, supplier. A bill repeats one with the same supplier and number that comes before it
    in order of ``doc``; bills without either can't be told.
    """
    made = F.floor((c("quantity_milli") * c("rate_paise") + 500) / 1000) - F.coalesce("discount_paise", F.lit(0))
    line = lines.select("doc", F.lit("line_arithmetic").alias("law"), within(made, c("taxable_paise"), tolerance).alias("verdict"), (made - c("taxable_paise")).cast("bigint").alias("out_by"))
    sums = lines.groupBy("doc").agg(F.sum("taxable_paise").alias("lines"), F.count_if(c("taxable_paise").isNull()).alias("unread"))
    first = bills.filter("number IS NOT NULL AND supplier IS NOT NULL").groupBy("supplier", "number").agg(F.min("doc").alias("first"))
    own = bills.join(sums, "doc", "left").join(first, ["supplier", "number"], "left")
    total = F.when(c("unread") == 0, c("lines"))
    parts = F.coalesce(c("cgst"), F.lit(0)) + F.coalesce(c("sgst"), F.lit(0)) + F.coalesce(c("igst"), F.lit(0))
    none = c("cgst").isNull() & c("sgst").isNull() & c("igst").isNull()
    grand = c("taxable_paise") + c("tax_paise") + F.coalesce(c("round_off"), F.lit(0))
    both, one = c("cgst").isNotNull() & c("sgst").isNotNull(), c("cgst").isNotNull() | c("sgst").isNotNull()
    shape = F.when(none, "INDETERMINATE").when(one & c("igst").isNotNull(), "FAIL").when(one & ~both, "FAIL").otherwise("PASS")
    known = F.when(c("number").isNotNull() & c("supplier").isNotNull() & c("grand_paise").isNotNull(), "PASS").otherwise("FAIL")
    laws = (
        ("lines_are_taxable", within(total, c("taxable_paise"), tolerance), total - c("taxable_paise")),
        ("parts_are_tax", F.when(~F.coalesce("tax_stated", F.lit(False)) | none, "INDETERMINATE").otherwise(within(parts, c("tax_paise"), tolerance)), F.when(~none, parts - c("tax_paise"))),
        ("sums_are_grand", within(grand, c("grand_paise"), tolerance), grand - c("grand_paise")),
        ("one_tax_shape", shape, F.lit(None)),
        ("mandatory_present", known, F.lit(None)),
        ("not_a_repeat", F.when(c("number").isNull() | c("supplier").isNull(), "INDETERMINATE").when(c("doc") > c("first"), "FAIL").otherwise("PASS"), F.lit(None)),
    )
    found = F.array(*[F.struct(F.lit(n).alias("law"), v.alias("verdict"), o.cast("bigint").alias("out_by")) for n, v, o in laws])
    return line.unionByName(own.select("doc", F.inline(found)))
