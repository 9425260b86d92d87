"""What was found to grow faster than its input, or to be too few tasks' work, in the third round."""

import datetime
from fractions import Fraction

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, extraction
from ledgerloom.plans import arrivals, scoring, views
from ledgerloom.sources import spend


def test_a_micro_batch_has_as_many_files_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "FILE_ROWS", 50, raising=False)
    seen = []

    def look(batch, number):
        per = batch.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum("id").alias("sum")).collect()
        seen.append([(r["n"], r["sum"]) for r in per])

    stream = arrivals._stream(spark, spark.range(0, 2000, 1, 8))
    stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and all(len(files) == 10 and max(n for n, _ in files) <= 50 for files in seen)
    assert sum(x for files in seen for _, x in files) == sum(range(2000))


def test_a_published_row_is_parsed_once_and_where_it_stands(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Supplier,Expense type,Description,Amount\n03/11/2025,A,Rent,x,"£1,005.50"\n3/1/2025,B,Rent,,£6\n' + "04/11/2025,C,Rent,z,7\n" * 500)
    (tmp_path / "b.csv").write_text('Amount,Supplier,Expense type,Description,Date\n-£5,D,Rent,"over\nlines",04-Nov-25\n1.234,E,Rent,y,31/02/2025\n')
    rows = spend.load(spend.read_files(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])).filter("size(reasons) = 0")
    got = sorted((r["path"][-5:], r["number"], str(r["date"]), r["party"], r["narration"], r["amount"]) for r in rows.collect())
    assert got[0] == ("a.csv", 1, "2025-11-03", "A", "x", 100550) and got[1:-1] == [("a.csv", n, "2025-11-04", "C", "z", 700) for n in range(3, 503)]
    assert got[-1] == ("b.csv", 1, "2025-11-04", "D", "over lines", -500)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1 and "strategy=broadcast" in plan  # a file's rows don't meet in one task to learn their columns
    lines = spend.records(spark, f"{tmp_path}/a.csv")
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString() and sorted(r["number"] for r in lines.collect()) == list(range(503))


def test_vouchers_that_no_error_can_fall_on_stay_where_they_are(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr(
        "concat('c', id % 2) AS company_key", "cast(id AS string) AS id", "date'2024-01-01' AS date", "concat('Supplier ', id % 8, ' Ltd') AS party", "concat('account ', id % 8) AS debit_account",
        "'Bank' AS credit_account", "id + 100 AS amount_paise", "CASE WHEN id % 8 < 2 THEN 5L END AS gst_paise",
    )
    made = evaluate.injected(rows, Fraction(1, 20), 7).withColumn("rank", F.row_number().over(W.partitionBy("company_key").orderBy(F.substring(evaluate.shuffled(7, "id"), 1, 3), F.rand(1))))
    kinds = {(r["company_key"], r["error_type"]): r["n"] for r in made.groupBy("company_key", "error_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {(c, t): n for c in ("c0", "c1") for t, n in [(None, 1900), *[(k, 25) for k, _ in evaluate.TYPES]]}
    assert made.filter("error_type IS NOT NULL").agg(F.max("rank")).first()[0] < 700  # errors fall on the first cells: most rows are in none of them
    plan = evaluate.injected(rows, Fraction(1, 20), 7)._jdf.queryExecution().optimizedPlan().toString()
    apart = plan[plan.index("LeftAnti") :]
    assert plan.index("Window") < plan.index("LeftAnti") and "Window" not in apart  # only the others are put in order


def test_a_document_is_read_once_for_both_outputs(spark):
    docs = spark.createDataFrame([("a", 1, b"1", "x"), ("b", 2, b"2", "x")], "name string, seq long, data binary, mime string")
    out = extraction.guarded(docs, extraction.by_row(lambda data, mime: {"x": 1 // (data[0] - 49)}), ("x",))
    assert [r["name"] for r in out.read.collect()] == ["b"] and [r["name"] for r in out.broken.collect()] == ["a"]
    assert all("MapInArrow" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (out.read, out.broken))


def test_entries_are_numbered_by_themselves(spark):
    own = [("c", f"{i % 7}-{i:03}", datetime.date(2024, 1, 1 + i % 9) if i % 10 else None) for i in range(101)] + [("d", "x", None)] + [("e", str(i), datetime.date(2024, 1, 1)) for i in range(5)]
    rows = spark.createDataFrame(own, "company_key string, id string, date date")
    want = views.halves(rows).filter("role = 'entry'").drop("role")
    days = views.counted(rows)
    entries = rows.join(views.cuts(rows, days), "company_key", "left").filter("NOT coalesce(struct(date, id) <= cut, false)").drop("cut")
    got = {(r["company_key"], r["id"]): r["seq"] for r in views.placed(entries, days).collect()}
    assert len(got) == 51 + 1 + 3 and got == {(r["company_key"], r["id"]): r["seq"] for r in want.collect()}


def test_cases_of_detectors_are_numbered_without_their_vouchers(spark, monkeypatch):
    written, kept = [], views.kept
    monkeypatch.setattr(views, "kept", lambda df: written.append(df) or kept(df))
    scoring.agg_detector_corpus(spark, "/root/testdata/sf0.001")
    assert sum("debit_account" in df.columns for df in written) == 1  # the book is written once, and nothing of it but days and cuts
