"""Queries held against their SQL, and what was found wrong in the third round."""

import datetime
import json
from pathlib import Path

import pytest

from ledgerloom import catalog
from ledgerloom.operators import fields
from ledgerloom.plans import arrivals, documents, more
from ledgerloom.streaming import proposals as P
from ledgerloom.streaming import windows as N

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name, place=DATA):
    duckdb = pytest.importorskip("duckdb")
    own = duckdb.connect()
    own.execute("SET TimeZone = 'UTC'")
    for table in Path(place).glob("*.parquet"):
        own.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = own.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    told = lambda rows: sorted(repr(tuple(r)) for r in rows)
    rows = want.fetchall()
    assert rows and told(catalog.queries()[name](spark, place).select(*columns).collect()) == told(rows)


def test_tax_ledgers_are_looked_up_in_the_chart_of_the_book(spark):
    same_as_sql(spark, "jn_ledger_map")


def test_ledgers_are_placed_by_the_chart_of_the_book(spark):
    same_as_sql(spark, "jn_ledger_group")


def test_a_line_that_is_not_late_joins_the_session_before_it(spark, tmp_path):
    at = lambda o, m: (o, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m))
    w = N.sessions(spark, f"file://{tmp_path}/w", gap="30 minutes", late="10 minutes")
    # the watermark stands at 35 before the second batch, beyond the end of the line at 0; the line at 29 is late from 59 on
    for number, lines in enumerate(([at("o", 0), at("p", 45)], [at("o", 29)], [at("p", 200)], [at("o", 100)])):
        w.add(spark.createDataFrame(lines, "operation_id string, ts timestamp"), number)
    assert sorted((r["operation_id"], r["lines"]) for r in w.rows("closed").collect()) == [("o", 2), ("p", 1)]
    assert [(r["operation_id"], r["lines"]) for r in w.rows("open").collect()] == [("p", 1)]
    assert [(r["operation_id"], r["batch"]) for r in w.rows("late").collect()] == [("o", 3)]


def test_proposals_of_one_slice_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SLICES", 1)
    schema = "proposal string, seq long, event string, reason string, operation_id string, actor string"
    passed = [(p, 2 * k + n, e, "why", "op", "me") for k, p in enumerate(("a", "b", "c")) for n, e in enumerate(("conservation_passed", "validation_passed"))]
    for part in (passed, [("a", 10, "confidence_high", "why", "op", "me"), ("c", 11, "confidence_medium", "why", "op", "me"), ("b", 3, "answered", "why", "op", "me"), ("b", 1, "answered", "why", "op", "me")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        P.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert {r["proposal"]: (r["state"], r["illegal"]) for r in P.states(spark, f"{tmp_path}/out").collect()} == {"a": ("decided", 0), "b": ("checked", 0), "c": ("asking", 0)}
    assert sorted((r["proposal"], r["seq"], r["verdict"]) for r in P.told(spark, f"{tmp_path}/out", True).collect()) == [("b", 1, P.LATE), ("b", 3, P.REPLAY)]


def test_pages_are_read_without_dealing_their_lines_anew(spark):
    lines = [
        (1, 0, "TAX INVOICE NO: A-7   DATE: 03/11/2025"), (1, 1, "TO TAL"), (1, 2, "Rs. 12.50"), (1, 3, "NET"), (1, 4, "9.00"), (1, 5, "9.00"), (1, 6, "TAX 1.00"), (1, 7, "TAX 2.00"),
        (2, 0, "on 03/11/2025"), (2, 1, "VENDOR: Acme Traders"), (2, 3, "TOTAL"), (2, 5, "7.00"), (2, 6, None), (2, 7, "GST"), (2, 8, "5.00"), (3, 0, "nothing"),
    ]
    # of 1, the net stands twice and the tax disagrees with itself; of 2, the total has no line below it (4 is missing)
    dealt = fields.page_fields(spark.createDataFrame(lines, "doc_id long, line_no int, text string").repartition("doc_id"))
    got = sorted(tuple(r) for r in dealt.collect())
    assert got == [(1, "date", "2025-11-03", 1.0), (1, "number", "A-7", 1.0), (1, "total", "1250", 0.5), (2, "date", "2025-11-03", 0.5), (2, "party", "Acme Traders", 1.0), (2, "tax", "500", 0.5)]
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and "doc_id" in x and "line_no" in x] == []  # a line and its neighbours aren't joined


def test_whole_documents_are_redacted(spark, tmp_path):
    n = len(documents._PLANTED)
    rows = [(0, "all is well", "web"), (n, "all is well, password: hunter-22 for Rs. 1,200.50", "web"), (2 * n, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["hidden"] for r in catalog.queries()["fn_redact"](spark, str(tmp_path)).collect()}
    assert got[n] == got[0] + 2 and [r["hash"] for r in catalog.queries()["fn_redact"](spark, str(tmp_path)).filter(f"doc_id = {2 * n}").collect()] == [None]


def test_a_page_is_read_in_one_pass(spark):
    lines = [
        (1, 0, "TAX INVOICE NO: A-7   DATE: 03/11/2025"), (1, 1, "Tax  Invoice no : A-7"), (1, 2, "VENDOR"), (1, 3, " "), (1, 4, "29ABCDE1234F1Z5"), (1, 5, " Acme Traders "), (1, 6, "Elsewhere"), (1, 7, "BILL TO"), (1, 8, "29ABCDE1234F1Z5 07ABCDE1234F1Z5"),
        (1, 9, "Someone"), (1, 10, "SUB\tTOTAL: Rs. 9.00"), (1, 11, "CGST @ 9% 1.00"), (1, 12, "sgst 1.00"), (1, 13, "TOTAL 11.00"), (1, 14, "GRAND TOTAL 11.00/-"),
        (2, 0, "SOLD BY: Left"), (2, 1, "SOLD BY: Right"), (2, 2, "BUYER"), (2, 3, "SHIP TO"), (2, 4, "Nobody"), (2, 5, "TOTAL 5.00"), (2, 6, "TOTAL 6.00"), (2, 7, "TAX 2.00"), (2, 9, "PLACE OF SUPPLY: Goa"), (2, 12, None),
        (3, 0, "nothing"), (3, 1, "07ABCDE1234F1Z5"), (4, 0, "DATE: 31/02/2026"), (5, 0, "BUYER"), (5, 1, "07ABCDE1234F1Z5"), (5, 4, "29ABCDE1234F1Z5"),
    ]
    dealt = spark.createDataFrame(lines, "doc_id long, line_no int, text string").repartition("doc_id")
    wide = fields.doc_fields(dealt)
    got = {r["doc_id"]: {k: v for k, v in r.asDict().items() if v is not None and k != "doc_id"} for r in wide.collect()}
    assert got == {
        1: {"number": "A-7", "date": "2025-11-03", "supplier_name": "Acme Traders", "supplier_tax_id": "29ABCDE1234F1Z5", "supplier_state": "29", "buyer_name": "29ABCDE1234F1Z5 07ABCDE1234F1Z5", "buyer_tax_id": "07ABCDE1234F1Z5", "buyer_state": "07",
            "net": "900", "cgst": "100", "sgst": "100", "tax": "200", "total": "1100", "tax_stated": False, "missing": []},
        2: {"place": "Goa", "tax": "200", "tax_stated": True, "missing": ["number", "date", "supplier_name", "total"]},
    }
    # as the single readers say
    assert {(r["doc_id"], r["side"], r["tax_id"]) for r in fields.tax_ids(dealt).collect() if r["side"]} == {(1, "supplier", "29ABCDE1234F1Z5"), (1, "buyer", "07ABCDE1234F1Z5")}
    assert [(r["doc_id"], r["value"]) for r in fields.below_heading(dealt, "buyer").collect()] == [(1, "29ABCDE1234F1Z5 07ABCDE1234F1Z5")]
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # once


def test_the_day_book_is_exported_compressed_and_read_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "folder", lambda _: f"file://{tmp_path}/book")
    same_as_sql(spark, "src_daybook_xml")
    files = [f for f in (tmp_path / "book").iterdir() if f.name.startswith("part-")]
    assert files and all(f.read_bytes()[:2] == b"\x1f\x8b" for f in files)


def test_a_book_is_written_compressed_with_every_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(more, "folder", lambda _: f"file://{tmp_path}/book")
    same_as_sql(spark, "snk_book_jsonl")
    files = [f for f in (tmp_path / "book/vouchers").iterdir() if f.name.startswith("part-")]
    assert files and all(f.read_bytes()[:2] == b"\x1f\x8b" for f in files)
    keys = {tuple(sorted(json.loads(r[0]))) for r in spark.read.text(f"{tmp_path}/book/vouchers").collect()}
    assert keys == {("amount_paise", "company_key", "credit_account", "date", "debit_account", "gst_paise", "id", "narration", "party", "seq")}
