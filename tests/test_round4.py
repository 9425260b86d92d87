"""What was found in the fourth round: work of pages, tables and arriving entries at size."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import reading as R
from ledgerloom.operators import fields
from ledgerloom.plans import arrivals

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    own = duckdb.connect()
    own.execute("SET TimeZone = 'UTC'")
    for table in Path(DATA).glob("*.parquet"):
        own.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = own.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    told = lambda rows: sorted(repr(tuple(r)) for r in rows)
    rows = want.fetchall()
    assert rows and told(catalog.queries()[name](spark, DATA).select(*columns).collect()) == told(rows)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_labels_of_fields_that_a_page_does_not_state_are_looked_near(spark):
    pages = {1: ["TOTAL 11.00", "TOTAL", "5.00", "TAX", "1.00"], 2: ["TOTAL", "Rs. 7.50", "NET 3.00", "NET", "9.00"], 3: ["GRAND TOTAL", "QTY 12", "TAX 1.00", "TAX 2.00"], 4: ["6.00", "TOTAL 8.00 x", "5.00"]}
    lines = spark.createDataFrame([(d, k, t) for d, own in pages.items() for k, t in enumerate(own)], "doc_id long, line_no int, text string").repartition("doc_id")
    told = lambda df: sorted(tuple(r) for r in df.filter("rejected = '' AND method = 'next_line'").select("doc_id", "field", "value", "line_no").collect())
    some, every = fields.nearby(lines, methods=fields.METHODS[:2], unread=True), fields.nearby(lines)
    stated = {(r["doc_id"], r["field"]) for r in fields.label_amounts(lines).collect()}
    assert stated == {(1, "total"), (2, "net"), (3, "tax")}
    assert told(some) == [x for x in told(every) if x[:2] not in stated] != []
    assert [x for x in told(every) if x[:2] in stated]
    plan = plan_of(fields.page_fields(lines))
    assert plan.count("wants_total") and "above" not in plan


def test_figures_are_told_apart_without_casts_that_fail(spark):
    rows = [("17", ""), ("17", "QTY"), ("4952.76", "rate % QTY"), ("84.00", "at 9% of"), ("123456", ""), ("1234567", "REF"), ("12345678", "SAC"), ("9876543210", ""), ("98765", "TEL"), ("03/11/2025", ""), ("3/13/2025", ""), ("10.005", ""), ("INV-1", ""), (None, ""), ("5", None)]
    df = spark.createDataFrame(rows, "v string, c string").select(R.not_money(F.col("v"), F.col("c")).alias("why"))
    got = [r["why"] for r in df.collect()]
    assert got == ["", "a quantity", "a quantity", "a percentage", "a postal code", "a document number", "a classification code", "a phone number", "", "a date", "a malformed amount", "a malformed amount", "a document number", "a malformed amount", ""]
    plan, cast = plan_of(df).lower(), "try_cast(regexp_extract(trim"
    assert plan.count(cast) == plan.count(f"null else ({cast}")  # of text that didn't match it is an exception for each row


def test_two_readings_print_and_read_the_bills_once(spark):
    same_as_sql(spark, "fn_merge_readings")
    assert "lineitem" not in (plan := catalog.queries()["fn_merge_readings"](spark, DATA)._jdf.queryExecution().executedPlan().toString()) and "line_no" not in plan


def test_a_table_is_read_in_one_pass_over_its_page(spark):
    pages = {
        1: ["QTY 5", "item qty rate amount", "Bolt M 8 2 3.00 6.00", "Nut 1 1.00 1.00", "total", "Late 9 9 9"],  # too few tokens end the rows
        2: ["QTY RATE AMOUNT", "1 2 3", "ITEM QTY AMOUNT", "Bolt 1 2.00"],  # the first header has no description
        3: ["TOTAL QUANTITY", "HSN/SAC AMOUNT", "DESCRIPTION OF GOODS HSN/SAC TAXABLE VALUE", "Big Bolt 9983 7.00", None, "ITEM QTY RATE", "Nut 9984 5.00"],
        4: ["nothing"],
    }
    lines = spark.createDataFrame([(d, k, t) for d, own in pages.items() for k, t in enumerate(own)], "doc_id long, line_no int, text string").repartition("doc_id")
    found = fields.table_rows(lines)
    got = {(r["doc_id"], r["line_no"]): r["cells"] and [tuple(c) for c in r["cells"]] for r in found.collect()}
    goods = lambda a, b, c: [("description", a), ("hsn_sac", b), ("taxable", c)]
    assert got == {
        (1, 2): [("description", "Bolt M 8"), ("quantity", "2"), ("rate", "3.00"), ("line_total", "6.00")], (1, 3): [("description", "Nut"), ("quantity", "1"), ("rate", "1.00"), ("line_total", "1.00")],
        (3, 3): goods("Big Bolt", "9983", "7.00"), (3, 4): None, (3, 5): goods("ITEM", "QTY", "RATE"), (3, 6): goods("Nut", "9984", "5.00"),
    }
    assert "Join" not in plan_of(found)


def test_entries_are_judged_by_facts_that_are_worked_out_once(spark, monkeypatch):
    seen, judged = [], arrivals.S.judged
    monkeypatch.setattr(arrivals.S, "judged", lambda *tables: seen.append(tables) or judged(*tables))
    same_as_sql(spark, "st_score")
    stream, *facts = seen[0]
    assert stream.isStreaming and "narration" not in stream.columns
    assert [x for t in facts for x in ("Aggregate", "Join", "Window") if x in plan_of(t)] == []  # files, which a micro-batch reads


def test_a_document_is_read_with_all_its_fields(spark):
    irn = "0123456789abcdefABCDEF" + "7" * 42
    lines = [
        (1, 0, f"IRN : {irn}"), (1, 1, "E-Way Bill No: 123456789012   PO NO: P-7"), (1, 2, "SELLER"), (1, 3, "07ABCDE1234F1Z5"), (1, 4, "Address : 1 High Street"), (1, 5, "CGST 1.00"), (1, 6, "UTGST @ 9% : 2.00"), (1, 7, "CESS 0.50"),
        (1, 8, "Round Off -0.25"), (1, 9, "Amount in words: Three Rupees"), (2, 0, "IGST 18.00"), (2, 1, "SGST 1.00"), (2, 2, "UTGST 2.00"), (2, 3, "ADDRESS: here"), (2, 4, "ADDRESS: there"), (3, 0, "IRN: 0123"), (3, 1, "EWB NO: 12345678901x"), (4, 0, "R/OFF 0.10"),
    ]
    wide = fields.doc_fields(spark.createDataFrame(lines, "doc_id long, line_no int, text string"))
    got = {r["doc_id"]: {k: v for k, v in r.asDict().items() if v not in (None, False) and k not in ("doc_id", "missing")} for r in wide.collect()}
    assert got == {
        1: {"irn": irn, "eway": "123456789012", "po": "P-7", "supplier_tax_id": "07ABCDE1234F1Z5", "supplier_state": "07", "supplier_name": "Address : 1 High Street", "supplier_address": "1 High Street", "buyer_address": "1 High Street",
            "cgst": "100", "sgst": "200", "cess": "50", "tax": "350", "round_off": "-25", "words": "Three Rupees"},
        2: {"igst": "1800", "tax": "1800", "tax_stated": True}, 4: {"round_off": "10"},
    }
    assert set(fields.DOC_FIELDS) < set(catalog.queries()["agg_doc_fields"](spark, DATA).columns)
    same_as_sql(spark, "agg_doc_fields")
