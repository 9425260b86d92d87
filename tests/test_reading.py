"""Readers of printed text on single values, and of pages of a few lines."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import reading as R


def values(spark, texts, *columns):
    df = spark.createDataFrame([(k, *(t if isinstance(t, tuple) else (t,))) for k, t in enumerate(texts)], "k int, t string" + (", u string" if isinstance(texts[0], tuple) else ""))
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_dates(spark):
    cases = [("Date: 01/04/2026", "2026-04-01", 2), ("2026-04-01", "2026-04-01", 1), ("2026/4/1", "2026-04-01", 1), ("01 Apr 2026", "2026-04-01", 1), ("1-September-2026", "2026-09-01", 1), ("3 Sept. 2026", "2026-09-03", 1), ("01/04/26", "2026-04-01", 2),
             ("01/04/69", "1969-04-01", 2), ("31/02/2026", None, 0), ("Version 1.2.34", None, 0), ("1.2.2034", "2034-02-01", 2), ("01 for 2026", None, 0), ("01/04/2026 and 01/04/2026", "2026-04-01", 2), ("2026-04-01, 2026-04-02", None, 2), ("28/01/2026", "2026-01-28", 1), (None, None, 0), ("", None, 0), ("12026-04-01", None, 0)]
    got = values(spark, [t for t, _, _ in cases], R.date(F.col("t"), R.DAY_FIRST).alias("d"), R.date(F.col("t"), R.EITHER).alias("e"), R.date(F.col("t"), R.NO_ORDER).alias("n"))
    for (text, want, many), (d, e, n) in zip(cases, got, strict=True):
        day = want and datetime.date.fromisoformat(want)
        assert d["value"] == day, text
        assert len(e["candidates"]) == many and e["value"] == (day if many == 1 else None), text
        assert (n["value"] is not None) == (want is not None and not any(c in text for c in "/.") or text == "2026/4/1" or text == "3 Sept. 2026"), text
        assert (d["why"] == "") == (day is not None)
    assert got[0][1]["ambiguous"] and got[13][0]["why"] == "several dates" and got[9][0]["why"] == "no date" and got[8][0]["why"] == "no such day"


def test_money(spark):
    cases = [("Rs. 1,234.56", 123456, "INR", ""), ("₹45,61,546", 456154600, "INR", ""), ("€1.234,56", 123456, "EUR", ""), ("1.234 EUR", 123400, "EUR", ""), ("GBP 1.234", None, "GBP", "finer than the minor unit"), ("Rp 39.600", 39600, "IDR", ""), ("JPY 1,000", 1000, "JPY", ""),
             ("$18.79", 1879, "UNKNOWN", "currency is not stated"), ("$18.79 (USD)", 1879, "USD", ""), ("$1,000", None, "UNKNOWN", "one mark that can be either"), ("1.234", None, "UNKNOWN", "one mark that can be either"), ("GST @ 18% INR 500.00", 50000, "INR", ""), ("18%", None, "UNKNOWN", "no amount"),
             ("100.00 and 200.00", None, "UNKNOWN", "several amounts"), ("INR 100.00 100.00", 10000, "INR", ""), ("-5.00 EUR", -500, "EUR", ""), ("19% 0.025 €", None, "EUR", "finer than the minor unit"), ("1.2.3 EUR", None, "EUR", "marks that can be neither"), ("CORP 5.00", 500, "UNKNOWN", "currency is not stated"),
             ("Steuerbetrag in GBP 163,16", 16316, "GBP", ""), (None, None, "UNKNOWN", "no amount"), ("18.5 % off", None, "UNKNOWN", "no amount"), ("€1.234,56 (USD rate)", 123456, "EUR", "")]
    got = values(spark, [t for t, *_ in cases], R.money(F.col("t")).alias("m"))
    assert [(t, m["minor"], m["code"], m["why"]) for (t, *_), (m,) in zip(cases, got, strict=True)] == cases


@pytest.mark.parametrize(("text", "want"), [("1,234.56", 123456), ("RS. 1,234.56", 123456), ("1,234.56 GBP", 123456), ("10.005", None), ("$ 7", 700), ("1e5", None), ("-3", -300), ("NaN", None), ("", None)])
def test_paise(spark, text, want):
    assert values(spark, [text], R.paise(F.col("t")).alias("p")) == [(want,)]


def test_artifacts_and_figures(spark):
    got = values(spark, ["|Certificati", "eTvan42", "TNoIte", "x.", "Qnmbcdfgh", "Acme Traders Ltd", " ", "McDonald"], R.artifacts(F.col("t")).alias("a"))
    assert [a for (a,) in got] == [["furniture"], ["mixed"], ["case"], ["short"], ["no vowel"], [], [], ["case"]]
    cases = [(("28/01/26", ""), "a date"), (("2018-09-21", ""), "a date"), (("18", "GST 18 %"), "a percentage"), (("12", "TOTAL QUANTITY: 12"), "a quantity"), (("998311", "HSN/SAC: 998311"), "a classification code"), (("9876543210", ""), "a phone number"), (("1,234.56", "CONTACT"), ""), (("400001", ""), "a postal code"), (("INV-2026-0041", ""), "a document number"), (("12345678", "BILL"), "a document number"), (("10.005", ""), "a malformed amount"), (("Rs. 500.00", "TOTAL"), "")]
    got = values(spark, [c for c, _ in cases], R.not_money(F.col("t"), F.col("u")).alias("w"))
    assert [w for (w,) in got] == [w for _, w in cases]


def test_pages(spark):
    from ledgerloom.operators import fields as P

    page = ["Tax Invoice No : A-1   DATE: 03/04/2026", "SUB  TOTAL", "100.00", "Total Quantity: 12", "AMOUNT DUE", "Rs. 118.00", "CGST @ 9% 9.00", "SGST 9.00", "SGST: 9.00"]
    other = ["TOTAL 5.00", "Total: 6.00", "TAX 1.00", "UTGST 1.00", "VENDOR:  ", "SUPPLIER? x"]
    lines = spark.createDataFrame([(d, k, t) for d, own in (("a", page), ("b", other)) for k, t in enumerate(own)], "doc_id string, line_no int, text string")
    told = {(r["doc_id"], r["field"]): (r["value"], r["confidence"]) for r in P.page_fields(lines).collect()}
    assert told == {("a", "total"): ("11800", 0.5), ("a", "number"): ("A-1", 1.0), ("a", "date"): ("2026-04-03", 1.0), ("a", "net"): ("10000", 0.5), ("b", "tax"): ("100", 1.0)}
    assert {r["doc_id"]: r["tax"] for r in P.split_tax(lines).collect()} == {"a": 1800, "b": None}
    assert P.page_fields(lines.limit(0)).count() == 0 and P.nearby(lines.limit(0)).count() == 0 and P.table_rows(lines).count() == 0


def test_redaction(spark):
    from ledgerloom.functions.redact import redacted

    cases = [("password: hunter22, x", "password: [REDACTED], x"), ("party='Acme Ltd'", "party=[REDACTED party len=8]"), ('"api-key" = "a b c"; y', '"api-key" = [REDACTED]; y'), ("http://u:p@h/x", "http://[REDACTED]@h/x"), ("amount=4,200.50 INR 5", "amount=[REDACTED amount] [REDACTED amount]"), ("a" * 64, "[REDACTED]"), ("environ({'A': 'b'})", "environ([REDACTED environment])"), ("tokens of text", "tokens of text"), (None, None)]
    got = values(spark, [c for c, _ in cases], redacted(F.col("t")).alias("a"))
    assert [a for (a,) in got] == [w for _, w in cases]
    twice = values(spark, [w for _, w in cases], redacted(F.col("t")).alias("a"))
    assert [a for (a,) in twice] == [w for _, w in cases]


def test_ledger_groups(spark):
    from ledgerloom.operators import placement as L

    chart = spark.createDataFrame([("c", "Cash", "Cash-in-Hand"), ("c", "Rent", "Indirect Expenses"), ("c", "Old", "Sundry Creditors")], "company_key string, account string, parent string")
    legs = spark.createDataFrame([("c", "1", "New", "Rent", "New"), ("c", "2", "New", "New", "Cash"), ("c", "3", "x", "Stock", "Till"), ("c", "4", "x", "RENT", ""), ("d", "5", "x", "A", "B"), ("c", "6", "New", "New", "Rent"), ("c", "7", "New", "New", "Suspense")], "company_key string, id string, party string, debit_account string, credit_account string")
    got = {(r["id"], r["side"]): r["found"] or r["refused"] for r in L.ledger_groups(legs, chart).collect()}
    assert got == {("1", "debit"): "Indirect Expenses", ("1", "credit"): "Sundry Creditors", ("2", "debit"): "Sundry Creditors", ("2", "credit"): "Cash-in-Hand", ("3", "debit"): "a person's decision", ("3", "credit"): "Cash-in-Hand", ("4", "debit"): "differs in case only", ("4", "credit"): "no name", ("5", "debit"): "no groups in use", ("5", "credit"): "no groups in use", ("6", "debit"): "group isn't in use", ("6", "credit"): "Indirect Expenses", ("7", "debit"): "the other leg doesn't tell", ("7", "credit"): "Cash-in-Hand"}
