"""Units on tiny tables, streams against batches, sources and sinks on small files."""

import datetime

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money as M
from ledgerloom.functions import text as X
from ledgerloom.operators import audit as A
from ledgerloom.operators import checks as C
from ledgerloom.operators import decide as D
from ledgerloom.operators import detect as T
from ledgerloom.operators import evaluate as E
from ledgerloom.operators import history as H
from ledgerloom.sources import books, spend
from ledgerloom.streaming import log as S

V = "company_key string, id string, date date, party string, narration string, debit_account string, credit_account string, amount_paise long, gst_paise long, seq long"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def book(spark, rows):
    return spark.createDataFrame([("c", i, day(d), p, "n", a, "Bank", m, g, s) for s, (i, d, p, a, m, g) in enumerate(rows)], V)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


@pytest.mark.parametrize("name,stem,form", [("M/s Acme Private Limited", "acme", "pvt_ltd"), ("Smith & Co Ltd", "smith co", "ltd"), ("Ltd", "", "ltd"), ("Ms. Halden Traders and Co", "halden traders", "and_co"), ("M.S. Halden", "halden", ""), ("Acme_Corp", "acme", "corp"), ("Ms", "ms", ""), ("", "", "")])
def test_supplier_names(spark, name, stem, form):
    n = value(spark, X.supplier_name(F.lit(name)))
    assert (n["stem"], n["form"]) == (stem, form)


@pytest.mark.parametrize("a,b,verdict", [("Acme Ltd", "ACME limited", "same"), ("Acme Ltd", "Acme LLP", "different"), ("Acme", "Acme Ltd", "ambiguous"), ("Ltd", "Ltd", "ambiguous"), ("Acme Ltd", "Bolt Ltd", "different"), ("Acme & Co", "Acme Ltd", "ambiguous")])
def test_supplier_verdicts(spark, a, b, verdict):
    x, y = X.supplier_name(F.lit(a)), X.supplier_name(F.lit(b))
    assert value(spark, X.same_supplier(x["stem"], x["form"], y["stem"], y["form"])) == verdict


@pytest.mark.parametrize("text,pence", [("£105,400.00", 10540000), ("-£82,354.00", -8235400), (" £534,722,000.00 ", 53472200000), ("37,109.87", 3710987), ("1.5", 150), ("1.555", None), ("", None), ("x", None), ("+3", 300)])
def test_pence(spark, text, pence):
    assert value(spark, M.pence(F.lit(text))) == pence


@pytest.mark.parametrize("text,date", [("03/11/2025", "2025-11-03"), ("04-Nov-25", "2025-11-04"), ("31/02/2025", None), ("2025-11-03", None), ("4-nov-25", "2025-11-04"), ("04-Foo-25", None)])
def test_spend_dates(spark, text, date):
    assert str(value(spark, M.spend_date(F.lit(text)))) == str(date)


@pytest.mark.parametrize("paise,text", [(-420050, "₹-4,200.50"), (0, "₹0.00"), (100000000, "₹10,00,000.00"), (99, "₹0.99"), (123456789012, "₹1,23,45,67,890.12")])
def test_money_text(spark, paise, text):
    assert value(spark, M.formatted(F.lit(paise).cast("bigint"))) == text


def test_small_scalars(spark):
    assert value(spark, M.scaled_rate(F.lit(1), F.lit(3), 10000)) == 3333 and value(spark, M.scaled_rate(F.lit(1), F.lit(8), 100)) == 13 and value(spark, M.scaled_rate(F.lit(1), F.lit(0), 100)) is None
    assert value(spark, M.tax_inside(F.lit(11800), F.lit(1800))) == 1800 and value(spark, M.tax_inside(F.lit(-100), F.lit(1800))) == -16
    assert value(spark, M.basis_points(F.lit("18 %"))) == 1800 and value(spark, M.thousandths(F.lit("2.5"))) == 2500 and value(spark, M.thousandths(F.lit("2.55555"))) is None
    assert value(spark, M.goods_code(F.lit("998713")))["kind"] == "SAC" and value(spark, M.goods_code(F.lit("12345"))) is None
    assert value(spark, M.crore(F.lit(12_340_000_000).cast("bigint"))) == "12.34"
    assert value(spark, X.stamped(F.lit("a [LEDGERLOOM:x]"), F.lit("y"))) is None
    assert value(spark, X.phrase_key(F.lit("Rent & 2024 Bill, no. 7 [LEDGERLOOM:op-1]"))) == "rent_&_bill_no"
    for one, other in (("Café Ltd.", "Cafe\u0301 ltd"), ("Straße", "STRASSE"), ("ﬁnance", "Finance"), ("Ǖ", "U\u0308\u0304"), ("ΟΔΟΣ", "οδος")):
        assert value(spark, X.folded(F.lit(one))) == value(spark, X.folded(F.lit(other))), one
        assert value(spark, X.vendor_key(F.lit(one))) == value(spark, X.vendor_key(F.lit(other)))
    assert value(spark, X.company_key(F.lit("Cafe\u0301 & Sons"))) == "café_sons" and value(spark, X.same_company(F.lit("É"), F.lit("E\u0301"))) and not value(spark, X.same_company(F.lit("É"), F.lit("é")))


def test_magnitude_bounds(spark):
    history = book(spark, [("h1", 0, "p", "A", 100, None), ("h2", 1, "p", "A", 200, None), ("h3", 5, "p", "A", 900, None), ("h4", 0, "p", "B", 10, None)])
    entries = book(spark, [("exact", 3, "p", "A", 600, None), ("over", 3, "p", "A", 601, None), ("same day", 5, "p", "A", 700, None), ("one prior", 3, "p", "B", 10_000, None), ("early", 0, "p", "A", 10_000, None)])
    assert {r["id"] for r in T.magnitude(entries, history).collect()} == {"over", "same day"}


def test_vendor_switch_and_first_use(spark):
    history = book(spark, [("h1", 0, "Acme Ltd", "A", 1, None), ("h2", 0, "ACME Limited", "A", 1, None), ("h3", 0, "Once", "A", 1, None), ("h4", 0, "Two", "A", 1, 5), ("h5", 0, "Two", "B", 1, None)])
    entries = book(spark, [("switch", 1, "acme ltd.", "B", 1, None), ("same", 1, "Acme Ltd", "A", 1, None), ("practice", 1, "Once", "B", 1, None), ("conflict", 1, "Two", "C", 1, None), ("blank", 1, "", "C", 1, None), ("tax", 1, "x", "B", 1, 3), ("no tax", 1, "x", "A", 1, 3)])
    assert {r["id"] for r in T.vendor_switch(entries, history).collect()} == {"switch"}
    assert {r["id"] for r in T.first_use(entries, history).collect()} == {"conflict", "blank"}
    assert {r["id"] for r in T.gst_anomaly(entries, history).collect()} == {"tax"}
    ranked = T.ranked(T.run(entries, history, tuple(T.DETECTORS)), cap=0).collect()
    assert all(not r["shown"] and r["dropped"] == 1 for r in ranked)
    with pytest.raises(ValueError, match="negative"):
        T.ranked(T.run(entries, history), cap=-1)


def test_checks_and_outcomes(spark):
    chart = spark.createDataFrame([("c", "A"), ("c", "Bank")], "company_key string, account string")
    rows = book(spark, [("ok", 0, "p", "A", 5, None), ("bad", 0, " ", "Z", 0, 3)])
    failed = {(r["id"], r["name"]) for r in C.run(rows, chart).filter("NOT passed").collect()}
    assert failed == {("bad", n) for n in ("amount_is_positive", "accounts_exist", "gst_not_larger_than_amount", "tax_lines_can_be_posted", "party_is_named")}
    seen = rows.withColumn("status", F.when(F.col("id") == "ok", "match").otherwise("no_match"))
    names = tuple(n for n in T.BUILT_IN if n != "vendor_switch")
    ready = D.with_problems(C.checked(T.flagged(T.with_facts(seen, rows.limit(0), names), names), chart))
    listed = {(r["id"], r["problem"]): r["at"] for r in D.listed(ready).collect()}
    assert listed["ok", "first_use"] == 1001 and listed["bad", "accounts_exist"] == 4 and listed["bad", "which_account"] == 5000
    got = {r["id"]: (r["outcome"], r["first"]) for r in D.outcomes(ready).collect()}
    assert got == {"ok": ("UNCLEAR", "first_use"), "bad": ("NOT_VALID", None)}
    answered = lambda names, asked: spark.createDataFrame([("c", "ok", names, asked)], "company_key string, id string, answered array<string>, asked int")
    say = lambda *a: {r["id"]: r["outcome"] for r in D.outcomes(ready, answered(*a)).collect()}["ok"]
    assert (say([], 0), say(["first_use"], 1), say([], 5)) == ("UNCLEAR", "NOT_VALID", "NOT_VALID")
    both = spark.createDataFrame([("VALID", "ASK"), ("VALID", "BLOCK"), ("UNCLEAR", "POST"), ("VALID", "POST")], "outcome string, band string")
    assert [r["outcome"] for r in D.narrowed(both).collect()] == ["UNCLEAR", "NOT_VALID", "UNCLEAR", "VALID"]


def test_laws(spark):
    rows = spark.createDataFrame([("a", 5, 5, [2, 3], 5, 4, 1, 5, 1, 6, 5), ("b", 5, None, [], 0, 4, 1, 6, 1, 6, 4), ("c", 1, 2, None, 0, None, 1, 5, 1, 6, 5)], "id string, debits long, credits long, lines array<long>, total long, net long, tax long, gross long, before long, after long, entry long")
    got = {(r["id"], r["law"]): r["verdict"][0] for r in C.conservation(rows).collect()}
    assert "".join(got[i, law] for i in "abc" for law in ("debits_equal_credits", "lines_sum_to_total", "net_plus_tax_is_gross", "balance_moves_by_entry")) == "PPPPIPFFFIIP"


def test_trial_balance_sums_to_zero_and_moves(spark):
    rows = book(spark, [("a", 0, "p", "A", 5, None), ("b", 1, "p", "B", 7, None), ("c", 2, "p", "A", -5, None)])
    assert {(r["account"], r["balance"]) for r in H.trial_balance(rows).collect()} == {("B", 7), ("Bank", -7)}
    assert {(r["account"], r["moved"]) for r in H.balance_difference(H.trial_balance(rows.limit(1)), H.trial_balance(rows)).collect()} == {("A", -5), ("B", 7), ("Bank", -2)}


def test_injection_is_exact_and_even(spark):
    own = [(f"v{i}", i, f"p{i % 5}", f"A{i % 5}", 100 + i, 5 if i % 5 in (0, 1) else None) for i in range(80)]
    rows = book(spark, own)
    bad, truth = E.inject(rows, Fraction(1, 8), 1)
    told = [tuple(r) for r in truth.collect()]
    assert bad.count() == 80 and sorted(t[2] for t in told) == ["first_use"] * 3 + ["gst_anomaly"] * 2 + ["magnitude"] * 2 + ["vendor_switch"] * 3
    before, after = {r["id"]: r for r in rows.collect()}, {r["id"]: r for r in bad.collect()}
    assert {i for i in after if after[i] != before[i]} == {t[1] for t in told}
    for _, i, kind, field, was, now in told:
        a, b = before[i], after[i]
        assert str(b[field]) == now and (was == "none" if kind == "gst_anomaly" else str(a[field]) == was)
        if kind == "vendor_switch":
            assert b["debit_account"] in {f"A{k}" for k in range(5)} - {a["debit_account"], a["credit_account"]}
        elif kind == "first_use":
            assert b["debit_account"] in E.UNPOSTED
        elif kind == "magnitude":
            assert b["amount_paise"] in [f * max(r[4] for r in own if r[3] == a["debit_account"]) for f in E.FACTORS]
        else:
            assert a["gst_paise"] is None and a["debit_account"] in {"A2", "A3", "A4"} and b["gst_paise"] == a["amount_paise"] * 1800 // 11800
    again = {tuple(r) for r in E.inject(rows.repartition(3), Fraction(1, 8), 1)[1].collect()}
    assert again == set(told)
    with pytest.raises(ValueError, match="whole number"):
        E.inject(rows, Fraction(1, 7), 1)
    with pytest.raises(ValueError, match="eligible"):
        E.inject(rows.fillna({"gst_paise": 3}), Fraction(1, 8), 1)


def test_targets_are_met_or_missed(spark):
    rows = spark.createDataFrame([("c", None, True)] + [("c", None, False)] * 9 + [("c", "magnitude", True), ("c", "first_use", False), ("d", "magnitude", True)], "company_key string, error_type string, flagged boolean")
    got = {r["company_key"]: r for r in E.rates(rows, 30, 15).collect()}
    c, d = got["c"], got["d"]
    assert (c["n1"], c["n1_verdict"], c["n2"], c["n2_verdict"], c["n3"], c["worst"], c["n3_verdict"]) == (1000, "MET", 833, "MET", 0, "first_use", "MISSED")
    assert (d["n1"], d["n1_verdict"], d["n2_verdict"], d["n3"], d["n3_verdict"]) == (None, "MISSED", "MISSED", 10000, "MET")
    with pytest.raises(ValueError, match="seconds"):
        E.rates(rows, 0, 15)


def test_halves_number_rows_by_day(spark):
    from ledgerloom.plans import views

    rows = [("c", f"{i % 7}-{i:03}", datetime.date(2024, 1, 1 + i % 9) if i % 10 else None) for i in range(101)] + [("d", "x", None)]
    got = {r["id"]: (r["seq"], r["role"]) for r in views.halves(spark.createDataFrame(rows, "company_key string, id string, date date")).filter("company_key = 'c'").collect()}
    order = sorted((d is not None, d or datetime.date.min, i) for c, i, d in rows if c == "c")
    assert got == {i: (k, "history" if k <= 50 else "entry") for k, (_, _, i) in enumerate(order, 1)}


def test_gaps_and_positions(spark):
    events = spark.createDataFrame([("a", 1, "open", "none"), ("a", 2, "shut", "open"), ("b", 1, "open", "odd"), ("c", 1, "open", "none"), ("c", 2, "shut", "none"), ("z", 1, "open", "none")], "scope string, seq long, state string, stated string")
    expected = spark.createDataFrame([("a", "none", "shut"), ("b", "none", "open"), ("c", "none", "shut"), ("m", "none", "open")], "scope string, start string, end string")
    assert {r["scope"]: r["why"] for r in A.gaps(events, expected, ["scope"]).collect()} == {"b": "FOREIGN_START", "c": "BROKEN", "m": "MISSING", "z": "UNKNOWN_SCOPE"}
    back = events.filter("scope <> 'z'").withColumn("state", F.when(F.col("seq") == 2, "edited").otherwise(F.col("state")))
    assert A.overwritten(events.filter("scope = 'a'"), back.filter("scope = 'a'"), ["state"]).collect()[0]["what"] == "CHANGED"
    states = spark.createDataFrame([("x", "COMPLETED"), ("x", "FAILED"), ("y", "COMPLETED"), ("z", "COMPLETED")], "batch_id string, state string")
    books_ = spark.createDataFrame([("y", True), ("z", False)], "batch_id string, accounted boolean")
    assert {r["batch_id"]: r["state"] for r in A.batch_state(states, ("FAILED", "COMPLETED"), books_).collect()} == {"x": "FAILED", "y": "COMPLETED", "z": "CRITICAL_FAILURE"}


def test_positions_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE", 10)
    rows = [(None, "x")] + [(k * k - 50, "x") for k in range(100)]
    back = [r for r in rows if r[0] != 80 * 80 - 50]
    made = lambda own: spark.createDataFrame(own, "seq long, state string").repartition(3)
    got = {(r["place"], r["what"]) for r in A.overwritten(made(rows), made(back), ["seq"]).collect()}
    assert got == {(p, "CHANGED") for p in range(82, 101)} | {(101, "MISSING")}
    assert A.overwritten(made([]), made(back[:2]), ["seq"]).count() == 2


def test_every_event_is_compared(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from ledgerloom import catalog

    events = [(k, k % 37, ("view", "click", "error", "purchase", "signup")[k % 5], "{}") for k in range(9500)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["what"]: r["n"] for r in catalog.queries()["jn_overwritten_all"](spark, str(tmp_path)).collect()}
    assert got["MISSING"] == 2 and got["CHANGED"] > 9000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in "lineitem orders supplier part nation".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    assert dict(con.execute(catalog.oracle_sql()["jn_overwritten_all"]).fetchall()) == got


def test_spend_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Date,Supplier,Expense type,Description,Amount\n03/11/2025,Acme,Rent,"two\nlines","£1,200.50"\nxx,,Rent,,abc\n04-Nov-25,Bolt,Fees,n,-5\nshort,row\n'.encode())
    (tmp_path / "b.csv").write_bytes("Date of Payment,Supplier Name,Expense Type,Narrative, £ \n03/11/2025,Café,Rent,n,£5\n".encode("cp1252"))
    rows = spend.load(spend.read_files(spark, str(tmp_path)))
    got = {(r["path"][-5:], r["number"]): r for r in rows.collect()}
    assert len(got) == 5 and got["a.csv", 1]["amount"] == 120050 and got["a.csv", 1]["narration"] == "two lines" and got["b.csv", 1]["party"] == "Café" and got["b.csv", 1]["amount"] == 500
    assert got["a.csv", 2]["reasons"] == ["narration is empty", "party is empty", "date is unreadable", "amount is unreadable"] and got["a.csv", 4]["reasons"] == [spend.SHORT_ROW]
    a = {r["path"][-5:]: r for r in spend.report(rows).collect()}["a.csv"]
    assert (a["rows"], a["loaded"], a["rejected"], a["refunds"]) == (4, 2, 2, 1) and a["by_reason"][spend.SHORT_ROW] == 1
    v = spend.as_vouchers(rows.filter("path LIKE '%a.csv'"), "DHSC", "http://x").orderBy("id").collect()
    assert [r["id"] for r in v] == ["DHSC-00001", "DHSC-00003"] and v[0]["provenance"]["gst_paise"] == spend.NOT_FOUND
    with pytest.raises(ValueError, match="amount"):
        spend.resolve(["Date", "Supplier", "Expense type", "Description"])
    with pytest.raises(ValueError, match="more than one"):
        spend.resolve(["Date", "Supplier", "Supplier name", "Expense type", "Description", "Amount"])


def test_books_and_sinks(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<B><VOUCHER><ID>1</ID><DATE>20240105</DATE><PARTY>p</PARTY><LEG><LEDGER>A</LEDGER><PAISE>5</PAISE></LEG><LEG><LEDGER>Bank</LEDGER><PAISE>-5</PAISE></LEG></VOUCHER><VOUCHER><ID>2</ID><DATE>20240105</DATE><LEG><LEDGER>A</LEDGER><PAISE>5</PAISE></LEG><LEG><LEDGER>B</LEDGER><PAISE>-3</PAISE></LEG><LEG><LEDGER>C</LEDGER><PAISE>-2</PAISE></LEG></VOUCHER></B>")
    got = {r["id"]: r for r in books.day_book(spark, str(tmp_path / "b.xml")).collect()}
    assert got["1"]["shape"] == "kept" and got["1"]["amount_paise"] == 5 and got["1"]["credit_account"] == "Bank" and got["2"]["shape"] == "skipped"
    (tmp_path / "ops.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","operation":"read","ok":true,"ms":5}\n{"ts":"2024-01-02T00:00:00Z","operation":"post","ok":false,"ms":7}\n{"ts":"2024-01-03T00:')
    assert [r["operation"] for r in books.operations(spark, str(tmp_path / "ops.jsonl"), last=2).collect()] == ["read", "post"]
    rows = book(spark, [("a", 0, "p", "A", 5, None)])
    books.write_book(rows, rows.limit(0), str(tmp_path / "book"))
    assert '"gst_paise":null' in "".join(r[0] for r in spark.read.text(str(tmp_path / "book/vouchers")).collect())
    log = spark.createDataFrame([(1, "not recorded"), (2, "me")], "seq long, actor string")
    books.append_actions(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("actor IS NULL").count() == 1
    assert [r["actor"] for r in books.actions(spark, str(tmp_path / "log")).collect()] == ["not recorded", "me"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = book(spark, [(f"v{i}", i % 7, f"Vendor {i % 5} Ltd", f"A{i % 3}", i, None) for i in range(60)])
    for k in range(3):
        rows.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = S.growing_index(spark, f"file://{tmp_path}/index")
    S.grow_index(stream, state, str(tmp_path / "cp")).awaitTermination()
    want = {(r["vendor_key"], r["account"], r["times"]) for r in H.vendor_index(rows).collect()}
    assert {(r["vendor_key"], r["account"], r["times"]) for r in state.read().collect()} == want
    log = rows.select("company_key", F.concat(F.lit("op"), F.col("seq") % 9).alias("operation_id"), "seq")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    claims = S.claims(spark, f"file://{tmp_path}/claims")
    S.claim(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), claims, str(tmp_path / "cp2")).awaitTermination()
    got = {r["operation_id"]: r["refused"] for r in claims.read().collect()}
    assert got == {r["operation_id"]: r["refused"] for r in A.claims(log).collect()}


def test_windowed_streams(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = spark.createDataFrame([("c", "op", t(0), "write_attempted", "valid", "x"), ("c", "op", t(10), "decided", "unknown", "y"), ("c", "op", t(200), "decided", "valid", "x")], "company_key string, operation_id string, ts timestamp, action string, outcome string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode, want in (("m", S.metrics(stream), "complete", 2), ("s", S.sessions(stream), "complete", 2), ("d", S.distinct_documents(stream), "append", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want
    entries = book(spark, [("e", 0, "Acme", "B", 1000, None)])
    history = book(spark, [("h1", 0, "Acme", "A", 10, None), ("h2", 0, "Acme", "A", 9, None), ("h3", 0, "Other", "B", 10, None), ("h4", 0, "Other", "B", 10, None)])
    entries = book(spark, [("e", 9, "ACME", "B", 100, None), ("ok", 9, "acme", "A", 9, None)])
    chart = spark.createDataFrame([("c", "A"), ("c", "B"), ("c", "Bank")], "company_key string, account string")
    assert {r["id"]: (r["outcome"], r["first"], r["n"]) for r in S.judged(entries, *S.facts(history), chart).collect()} == {"e": ("UNCLEAR", "vendor_switch", 2), "ok": ("VALID", None, 0)}


def test_queries_are_known_before_any_session():
    import subprocess
    import sys
    from pathlib import Path

    made = subprocess.run([sys.executable, "-c", "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    queries, sql = map(int, made.stdout.split())
    assert queries >= sql > 150
