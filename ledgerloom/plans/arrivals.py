"""Queries that read files and streams, or write and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import checks as C
from ..operators import documents as D
from ..operators import fields as P
from ..operators import history as H
from ..shared import folder, kept
from ..sources import books, spend
from ..streaming import log as S
from . import views as V
from .ledger import INDEX, LOOKUP, PROBLEMS
from .reading import BILLS, pages


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of published spend, a file per customer group, in two encodings; read back."""
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 16
    rows = o.select(k.alias("k"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("Café "), F.col("o_custkey").cast("string")).alias("Supplier"), F.lit("Purchases").alias("Expense type"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("Description"), F.concat(F.lit("£"), F.format_number("o_totalprice", 2)).alias("Amount"))
    one, two = folder(spark), folder(spark)
    for path, part, charset in ((one, k % 2 == 0, "UTF-8"), (two, k % 2 == 1, "ISO-8859-1")):
        rows.filter(part).repartition("k").drop("k").write.option("header", True).option("encoding", charset).csv(path)
    return spend.load(spend.read_files(spark, [f"{one}/*.csv", f"{two}/*.csv"]))


_ORDERS = "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'Café ' || o_custkey AS party, 'order ' || o_orderkey AS narration, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders"
register("src_encoding", lambda s, d: _published(s, d).select(F.col("date").cast("string").alias("date"), "party", "narration", "amount"), _ORDERS)


def src_as_voucher(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spend.as_vouchers(_published(spark, sf_dir), "DEPT", "https://example.org/spend.csv")
    number = F.length(F.regexp_extract("id", "^DEPT-([0-9]{5,})$", 1)) >= 5
    return v.select("narration", "party", "debit_account", "credit_account", "amount_paise", "gst_paise", number.alias("numbered"), F.col("provenance")["amount_paise"].alias("amount_from"), F.col("provenance")["credit_account"].alias("credit_from"))


register("src_as_voucher", src_as_voucher, f"SELECT narration, party, 'Purchases' AS debit_account, 'not in source' AS credit_account, amount AS amount_paise, CAST(NULL AS BIGINT) AS gst_paise, true AS numbered, 'https://example.org/spend.csv (pence)' AS amount_from, 'not found' AS credit_from FROM ({_ORDERS})")


def src_daybook_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vouchers exported as compressed XML (a file per task, read by one), one in six with three legs, and read back."""
    path, a = folder(spark), F.col("amount_paise")
    legs = F.array(F.struct(F.col("debit_account").alias("LEDGER"), a.alias("PAISE")), F.struct(F.col("credit_account").alias("LEDGER"), F.when(a % 6 == 0, 1 - a).otherwise(-a).alias("PAISE")))
    legs = F.when(a % 6 == 0, F.concat(legs, F.array(F.struct(F.lit("Rounding").alias("LEDGER"), F.lit(-1).cast("bigint").alias("PAISE"))))).otherwise(legs)
    V.vouchers(spark, sf_dir).select(F.col("id").alias("ID"), F.date_format("date", "yyyyMMdd").alias("DATE"), F.col("party").alias("PARTY"), F.col("narration").alias("NARRATION"), legs.alias("LEG")).write.format("xml").option("rootTag", "ENVELOPE").option("rowTag", "VOUCHER").option("compression", "gzip").save(path)
    return books.day_book(spark, path).groupBy("shape").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount"), F.count_distinct("party").alias("parties"), F.max("date").cast("string").alias("last"))


register("src_daybook_xml", src_daybook_xml, V.VIEWS + "SELECT CASE WHEN amount_paise % 6 = 0 THEN 'skipped' ELSE 'kept' END AS shape, count(*) AS n, sum(amount_paise)::BIGINT AS amount, count(DISTINCT party) AS parties, CAST(max(date) AS VARCHAR) AS last FROM vouchers GROUP BY 1")


def src_audit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as log lines, one in forty torn off in the middle, and read back."""
    path, n = folder(spark), F.col("event_id")
    e = V.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("ts"), F.col("event_type").alias("operation"), (F.col("user_id") % 20).cast("string").alias("company"), (F.col("value") >= 5).alias("ok"), F.round(F.col("value") * 100).cast("bigint").alias("ms"), F.lit("").alias("detail")))
    e.select(F.when(n % 40 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    return books.operations(spark, path).groupBy("operation").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"), F.sum("ms").alias("ms"))


register("src_audit_jsonl", src_audit_jsonl, "SELECT event_type AS operation, count(*) AS n, count(*) FILTER (value >= 5) AS good, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS ms FROM events WHERE event_id % 40 <> 0 GROUP BY 1")


def snk_company_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written by company; then one company is replaced by what all its vouchers say, and another is forgotten."""
    book = V.Book(spark, sf_dir, ("party", "debit_account"))
    own = books.Companies(spark, folder(spark), "company_key string, vendor_key string, account string, times bigint")
    own.write(H.vendor_index(book.history).select("company_key", "vendor_key", "account", "times"))
    first, second = (r["n_name"] for r in V.table(spark, sf_dir, "nation").join(book.history.select(F.col("company_key").alias("n_name")).distinct(), "n_name").orderBy("n_name").limit(2).collect())
    own.replace(H.vendor_index(book.vouchers.filter(F.col("company_key") == first)).select("company_key", "vendor_key", "account", "times"), first)
    own.forget(second)
    return own.read()


register("snk_company_replace", snk_company_replace, LOOKUP + """
, two AS (SELECT company_key, row_number() OVER (ORDER BY company_key) AS r FROM (SELECT DISTINCT company_key FROM history)), every AS (SELECT company_key, vendor_key, debit_account FROM keyed UNION ALL SELECT company_key, vendor_key, debit_account FROM ek)
SELECT p.company_key, vendor_key, account, times FROM pairs p JOIN two ON two.company_key = p.company_key WHERE r > 2
UNION ALL SELECT e.company_key, vendor_key, debit_account, count(*) FROM every e JOIN two ON two.company_key = e.company_key WHERE r = 1 AND vendor_key <> '' GROUP BY ALL""")


def chk_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of documents of several kinds: what can't be told about a kind doesn't apply to it."""
    a = F.col("amount_paise")
    kind = F.element_at(F.array(*map(F.lit, ("invoice", "receipt", "credit_note", "typed_expense_note"))), (a % 4 + 1).cast("int"))
    laws = F.array(*[F.struct(F.lit(n).alias("law"), v.alias("verdict")) for n, v in (("lines", F.when(a % 3 == 0, "INDETERMINATE").otherwise("PASS")), ("tax", F.when(a % 5 == 0, "FAIL").when(a % 5 == 1, "INDETERMINATE").otherwise("PASS")))])
    return C.applicable(V.vouchers(spark, sf_dir).select("id", kind.alias("kind"), F.inline(laws)))


register("chk_applicable", chk_applicable, V.VIEWS + """
, l AS (SELECT id, (['invoice', 'receipt', 'credit_note', 'typed_expense_note'])[amount_paise % 4 + 1] AS kind, unnest(['lines', 'tax']) AS law, unnest([CASE WHEN amount_paise % 3 = 0 THEN 'INDETERMINATE' ELSE 'PASS' END, CASE amount_paise % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'INDETERMINATE' ELSE 'PASS' END]) AS verdict FROM vouchers)
SELECT id, kind, law, CASE WHEN verdict = 'INDETERMINATE' AND kind IN ('receipt', 'typed_expense_note') THEN 'NOT_APPLICABLE' ELSE verdict END AS verdict FROM l""")


def set_live_vs_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vendor, whether the set of accounts that history remembers is the set that all its vouchers give."""
    book = V.Book(spark, sf_dir, ("party", "debit_account"))
    sets = lambda rows, name: H.with_vendor(rows).filter("vendor_key <> ''").groupBy("company_key", "vendor_key").agg(F.array_sort(F.collect_set("debit_account")).alias(name))
    both = sets(book.history, "remembered").join(sets(book.vouchers, "live"), ["company_key", "vendor_key"])
    return both.select("company_key", "vendor_key", (F.col("remembered") == F.col("live")).alias("same"), F.array_join(F.array_except("live", "remembered"), ",").alias("new"))


register("set_live_vs_remembered", set_live_vs_remembered, LOOKUP + """
, l AS (SELECT company_key, vendor_key, debit_account FROM keyed UNION SELECT company_key, vendor_key, debit_account FROM ek), r AS (SELECT DISTINCT company_key, vendor_key, debit_account FROM keyed WHERE vendor_key <> ''),
d AS (SELECT l.*, r.debit_account AS old FROM l LEFT JOIN r ON r.company_key = l.company_key AND r.vendor_key = l.vendor_key AND r.debit_account = l.debit_account WHERE (l.company_key, l.vendor_key) IN (SELECT (company_key, vendor_key) FROM r))
SELECT company_key, vendor_key, bool_and(old IS NOT NULL) AS same, coalesce(string_agg(debit_account, ',' ORDER BY debit_account) FILTER (old IS NULL), '') AS new FROM d GROUP BY 1, 2""")
register("win_section_ids", lambda s, d: P.tax_ids(pages(s, d)).select("doc_id", "side", "tax_id", "state"), BILLS + " SELECT o AS doc_id, 'buyer' AS side, '29ABCDE1234F1Z5' AS tax_id, '29' AS state FROM bills WHERE o % 2 = 0")


def win_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The itemised block of each printed bill; one bill in ten has a row that can't be read, and one a second header."""
    rows = pages(spark, sf_dir)
    o, item = F.col("doc_id"), F.col("text").startswith("Part ")
    rows = rows.withColumn("text", F.when((o % 10 == 3) & item, F.regexp_replace("text", r"[0-9.]+$", "?")).when((o % 10 == 5) & F.col("text").startswith("SUB"), "DESCRIPTION QTY RATE AMOUNT").otherwise(F.col("text")))
    found = D.itemised(rows, "^DESCRIPTION ", "^SUB TOTAL|^TAX|^CGST", r"^Part .* ([0-9.]+)$")
    return found.select("doc_id", F.size("items").alias("n"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum"), "why")


register("win_line_items", win_line_items, BILLS + """
SELECT o AS doc_id, CASE WHEN o % 10 NOT IN (3, 5) THEN n END AS n, CASE WHEN o % 10 NOT IN (3, 5) THEN net END AS sum, CASE o % 10 WHEN 3 THEN 'a row can''t be read' WHEN 5 THEN 'more than one block' ELSE '' END AS why FROM bills""")


# Streams


#: Rows of a file that a stream is read from, at most: a micro-batch has as many tasks as its rows ask for.
FILE_ROWS = 100_000


def _stream(spark: SparkSession, rows: DataFrame, batches: int = 4) -> DataFrame:
    """A table as a stream of so many micro-batches, or fewer; each has its share of the files, which are written where the rows are."""
    path = folder(spark)
    if rows.rdd.getNumPartitions() < batches:
        rows = rows.repartition(batches)
    rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def st_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index grown voucher by voucher; what the batch index of all history says."""
    place = folder(spark)
    state = S.growing_index(spark, f"{place}/index")
    S.grow_index(_stream(spark, V.Book(spark, sf_dir, ("party", "debit_account"), numbered=True).history), state, f"{place}/checkpoint").awaitTermination()
    return state.read().select("company_key", "vendor_key", "account", "times")


register("st_index", st_index, INDEX + " SELECT company_key, vendor_key, account, times FROM pairs")


def st_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries judged as they arrive, against what history teaches; the ceiling is that of all history here, as entries arrive after it."""
    columns = ("party", "debit_account", "credit_account", "amount_paise", "gst_paise")  # no rule asks for the narration
    book, place = V.Book(spark, sf_dir, columns), folder(spark)
    # written once, not worked out again by every micro-batch; and as files they show their size, which says how to join them
    vendors, accounts = (kept(x) for x in S.facts(book.history))
    found = S.judged(_stream(spark, book.entries.select("company_key", "id", "date", *columns)), vendors, accounts, book.chart)
    found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out")


register("st_score", st_score, PROBLEMS.replace("mag AS (SELECT e.company_key, e.id, e.debit_account, e.amount_paise, sum(d.n) AS seen, max(d.high) AS high FROM entries e JOIN days d ON d.company_key = e.company_key AND d.debit_account = e.debit_account AND d.date < e.date GROUP BY ALL)", "mag AS (SELECT e.company_key, e.id, e.debit_account, e.amount_paise, sum(d.n) AS seen, max(d.high) AS high FROM entries e JOIN days d ON d.company_key = e.company_key AND d.debit_account = e.debit_account GROUP BY ALL)") + """
, g AS (SELECT company_key, id, bool_or(NOT answerable) AS hopeless, arg_min(problem, at_place) AS head, count(*) AS n FROM problems GROUP BY ALL)
SELECT e.company_key, e.id, CASE WHEN hopeless THEN 'NOT_VALID' WHEN n IS NULL THEN 'VALID' ELSE 'UNCLEAR' END AS outcome, CASE WHEN NOT hopeless THEN head END AS first, coalesce(n, 0) AS n
FROM entries e LEFT JOIN g ON g.company_key = e.company_key AND g.id = e.id""")


def st_dedupe_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream: how often each text, and each bill of a supplier by its number, was seen."""
    d = V.table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("seq"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("supplier"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 40).cast("string")).alias("number"))
    place = folder(spark)
    state = S.seen_documents(spark, f"{place}/seen")
    S.remember_documents(_stream(spark, rows), state, f"{place}/checkpoint").awaitTermination()
    return state.read().select("hash", "supplier", "number", "n")


register("st_dedupe_docs", st_dedupe_docs, """
SELECT sha256(text) AS hash, '' AS supplier, '' AS number, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1
UNION ALL SELECT '', source, CAST(doc_id % 40 AS VARCHAR), count(*) FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND source IS NOT NULL GROUP BY ALL""")
