"""Queries on documents and bills, and on the log as a stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as X
from ..functions.redact import CREDENTIALS, redacted
from ..operators import checks as C
from ..operators import documents as D
from ..shared import folder, spread
from ..streaming import log as S
from ..streaming import windows as N
from . import views as V


def _bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as bills and line items as their lines; one order in seven states a wrong total, one in five no tax."""
    line, orders = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "orders")
    amount = V.paise(F.col("l_extendedprice"))
    lines = line.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"), (F.col("l_quantity").cast("bigint") * 1000).alias("quantity_milli"), F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)").alias("rate_paise"),
        F.when(F.col("l_discount") > 0, F.lit(0).cast("bigint")).alias("discount_paise"), F.when(F.col("l_linenumber") != 7, amount).alias("taxable_paise"),
    )
    sums = lines.groupBy("doc").agg(F.sum("taxable_paise").alias("sum"))
    bills = orders.select(F.col("o_orderkey").alias("doc")).join(sums, "doc").withColumn("taxable_paise", F.when(F.col("doc") % 7 == 0, F.col("sum") + 500).otherwise(F.col("sum")))
    half = F.expr("taxable_paise * 9 div 100")
    taxed = F.col("doc") % 5 != 0
    bills = bills.withColumns({"cgst": F.when(taxed, half), "sgst": F.when(taxed & (F.col("doc") % 11 != 0), half), "igst": F.when(taxed & (F.col("doc") % 13 == 0), half)})
    bills = bills.withColumns({"tax_paise": F.when(taxed, half * 2), "tax_stated": taxed & (F.col("doc") % 3 != 0), "round_off": F.lit(None).cast("bigint"), "number": (F.col("doc") - F.when(F.col("doc") % 23 == 1, 1).otherwise(0)).cast("string"), "supplier": F.when(F.col("doc") % 17 != 0, F.lit("s"))})
    return bills.withColumn("grand_paise", F.col("taxable_paise") + F.coalesce(F.col("tax_paise"), F.lit(0)) + F.when(F.col("doc") % 19 == 0, 10_000).otherwise(0)), lines


def chk_bill_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.bill_laws(*_bills(spark, sf_dir))
    return found.groupBy("doc", "law", "verdict").agg(F.count("*").alias("n"), F.sum("out_by").alias("out_by"))


register("chk_bill_laws", chk_bill_laws, """
WITH l AS (SELECT l_orderkey AS doc, CAST(l_quantity AS BIGINT) * 1000 AS q, CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS rate, CASE WHEN l_linenumber <> 7 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS taxable FROM lineitem),
m AS (SELECT *, (q * rate + 500) // 1000 AS made FROM l),
s AS (SELECT doc, sum(taxable)::BIGINT AS sums, count(*) FILTER (taxable IS NULL) AS unread FROM l GROUP BY 1),
b AS (SELECT doc, sums, unread, sums + CASE WHEN doc % 7 = 0 THEN 500 ELSE 0 END AS taxable FROM s JOIN orders ON o_orderkey = doc),
t AS (SELECT *, CASE WHEN doc % 5 <> 0 THEN taxable * 9 // 100 END AS half FROM b),
u AS (SELECT *, half AS cgst, CASE WHEN doc % 11 <> 0 THEN half END AS sgst, CASE WHEN doc % 13 = 0 THEN half END AS igst, half * 2 AS tax, taxable + coalesce(half * 2, 0) + CASE WHEN doc % 19 = 0 THEN 10000 ELSE 0 END AS grand FROM t),
f AS (
  SELECT doc, 'line_arithmetic' AS law, CASE WHEN taxable IS NULL THEN 'INDETERMINATE' WHEN abs(made - taxable) <= 100 THEN 'PASS' ELSE 'FAIL' END AS verdict, made - taxable AS out_by FROM m
  UNION ALL SELECT doc, 'lines_are_taxable', CASE WHEN unread > 0 OR taxable IS NULL THEN 'INDETERMINATE' WHEN abs(sums - taxable) <= 100 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN unread = 0 THEN sums - taxable END FROM u
  UNION ALL SELECT doc, 'parts_are_tax', CASE WHEN half IS NULL OR doc % 3 = 0 THEN 'INDETERMINATE' WHEN abs(cgst + coalesce(sgst, 0) + coalesce(igst, 0) - tax) <= 100 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN half IS NOT NULL THEN cgst + coalesce(sgst, 0) + coalesce(igst, 0) - tax END FROM u
  UNION ALL SELECT doc, 'sums_are_grand', CASE WHEN tax IS NULL OR grand IS NULL THEN 'INDETERMINATE' WHEN abs(taxable + tax - grand) <= 100 THEN 'PASS' ELSE 'FAIL' END, taxable + tax - grand FROM u
  UNION ALL SELECT doc, 'one_tax_shape', CASE WHEN half IS NULL THEN 'INDETERMINATE' WHEN igst IS NOT NULL OR sgst IS NULL THEN 'FAIL' ELSE 'PASS' END, NULL FROM u
  UNION ALL SELECT doc, 'mandatory_present', CASE WHEN doc % 17 <> 0 AND grand IS NOT NULL THEN 'PASS' ELSE 'FAIL' END, NULL FROM u
  UNION ALL SELECT doc, 'not_a_repeat', CASE WHEN doc % 17 = 0 THEN 'INDETERMINATE' WHEN doc % 23 = 1 AND (doc - 1) % 17 <> 0 AND doc - 1 IN (SELECT doc FROM u) THEN 'FAIL' ELSE 'PASS' END, NULL FROM u)
SELECT doc, law, verdict, count(*) AS n, sum(out_by)::BIGINT AS out_by FROM f GROUP BY ALL""")


#: What is put into texts, and what has to be there afterwards.
_PLANTED = (
    (" password: hunter-22, then", " password: [REDACTED], then"), (" {'secret': 'two words here'} ", " {'secret': [REDACTED]} "), (' "api-key" = "a b c"; ', ' "api-key" = [REDACTED]; '), (" my-API-Key=xyz ", " my-API-Key=[REDACTED] "),
    (" vendor='Halden Paper Mill' ", " vendor='[REDACTED vendor len=17]' "), (" party=Acme and more", " party=[REDACTED party len=4] and more"), (" Supplier : 'Other Mill' ", " Supplier : [REDACTED supplier len=10] "),
    (" gst_paise: 12,345.60 and amount=-7 ", " gst_paise: [REDACTED amount] and amount=[REDACTED amount] "), (" amount=unknown ", " amount=unknown "), (" ₹ 750 or Rs.1,200.50 or INR 9 ", " [REDACTED amount] or [REDACTED amount] or [REDACTED amount] "),
    (" ftp://guest:pw@files/x ", " ftp://[REDACTED]@files/x "), (" https://example.org/a ", " https://example.org/a "), (" said Bearer abc.def and", " said Bearer [REDACTED] and"), (" Authorization: Basic dXNlcg== ", " Authorization: [REDACTED] [REDACTED] "),
    (" digest " + "0aF9" * 16 + " ", " digest [REDACTED] "), (" ad_" + "f" * 64 + " ", " ad_" + "f" * 64 + " "), (" environ({'PATH': '/bin', 'TOKEN': 'x'}) ", " environ([REDACTED environment]) "), (" secretive: yes, tokens ", " secretive: yes, tokens "),
)


def _planted(n: int) -> Column:
    return F.element_at(F.array(*[F.lit(p[n]) for p in _PLANTED]), (F.col("doc_id") % len(_PLANTED) + 1).cast("int"))


def fn_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a party that was learned, a figure, a login, a bearer's token and an amount behind them; then their words (no figures, no signs) with something planted in the middle and at the end; redacted."""
    d = spread(V.table(spark, sf_dir, "documents"))
    words = F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z\n]+", " "), r"(?i)\b(basic|bearer|rs|inr)\b", "-")
    whole = F.concat("text", F.lit(" vendor='Halden Paper Mill' gst_paise: 12,345.60 ftp://guest:pw@files/x Bearer abc ₹ 750 and "), "source")
    parts = (whole, F.concat(words, _planted(0), F.lit("."), words, _planted(0)))
    first, second = (redacted(x, {"Halden Paper Mill": "vendor", "short": ""}) for x in parts)
    out = F.concat(first, F.lit("\n"), second)
    return d.select("doc_id", out.alias("x")).select("doc_id", F.sha2("x", 256).alias("hash"), F.size(F.regexp_extract_all("x", F.lit(r"\[REDACTED"), F.lit(0))).cast("bigint").alias("hidden"))


register("fn_redact", fn_redact, r"""
WITH w AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z\n]+', ' ', 'g'), '(?i)\b(basic|bearer|rs|inr)\b', '-', 'g') AS w, ([""" + ", ".join("'" + p[1].replace("'", "''") + "'" for p in _PLANTED) + r"""])[doc_id % """ + str(len(_PLANTED)) + r""" + 1] AS p FROM documents),
t AS (SELECT doc_id, replace(text || ' vendor=''Halden Paper Mill'' gst_paise: 12,345.60 ftp://guest:pw@files/x Bearer abc ₹ 750 and ' || source, 'Halden Paper Mill', '[REDACTED vendor len=17]') AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(x, '://[^/\s@]+@', '://[REDACTED]@', 'g'), '(?i)\b(Bearer|Basic)\s+\S+', '\1 [REDACTED]', 'g') AS x FROM t),
b AS (SELECT doc_id, regexp_replace(x, '(?i)\b(""" + "|".join(CREDENTIALS) + r""")\b(["'']?\s*[=:]\s*)(?:"[^"]*"|''[^'']*''|[^\s,;)\]}]+)', '\1\2[REDACTED]', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(x, '(?i)\b(amount_paise|gst_paise|amount)\b(["'']?\s*[=:]\s*)(-?\d[\d,]*(?:\.\d+)?)', '\1\2[REDACTED amount]', 'g') AS x FROM b),
e AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\b[0-9a-fA-F]{64,}\b', '[REDACTED]', 'g'), '(?i)(?:₹|\bRs\.?\s*|\bINR\s+)\s*\d[\d,]*(?:\.\d+)?', '[REDACTED amount]', 'g') AS x FROM c),
x AS (SELECT doc_id, e.x || chr(10) || w || p || '.' || w || p AS x FROM e JOIN w USING (doc_id)) SELECT doc_id, sha256(x) AS hash, len(regexp_extract_all(x, '\[REDACTED')) AS hidden FROM x""")


def fn_bill_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Invoice total ₹ 5").when(F.col("doc_id") % 3 == 1, " tax").otherwise(""))
    return d.select("doc_id", F.array_join(D.signals(text), "; ").alias("signals"), (F.size(D.signals(text)) >= D.ENOUGH).alias("bill"))


register("fn_bill_signals", fn_bill_signals, r"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Invoice total ₹ 5' WHEN 1 THEN ' tax' ELSE '' END AS x FROM documents),
s AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(x, '(?i)\b(invoice|bill|receipt|challan)\b') THEN 'names itself a bill' END, CASE WHEN regexp_matches(x, '(?i)\b(GST|VAT|tax)\b') THEN 'mentions tax' END,
  CASE WHEN regexp_matches(x, '(?i)\b(total|amount|payable|due)\b') THEN 'mentions an amount' END, CASE WHEN regexp_matches(x, '(?i)\b(GSTIN|PAN|TAN)\b') THEN 'names a tax identity' END, CASE WHEN regexp_matches(x, '(?i)₹|Rs\.?|INR') THEN 'prints a currency' END,
  CASE WHEN regexp_matches(x, '(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b') THEN 'carries a GSTIN' END], lambda y: y IS NOT NULL) AS l FROM t)
SELECT doc_id, array_to_string(l, '; ') AS signals, len(l) >= 2 AS bill FROM s""")


def _statused(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Invoice total 5").when(F.col("doc_id") % 3 == 1, " tax").otherwise(""))
    return D.status(d.select("doc_id", text.alias("text"), X.legible(text).alias("share"), D.signals(text).alias("signals"), (F.col("doc_id") % 6).alias("missing"), (F.col("doc_id") % 4).alias("failed")))


_STATUS = r"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Invoice total 5' WHEN 1 THEN ' tax' ELSE '' END AS x FROM documents),
n AS (SELECT *, regexp_matches(x, '(?i)\b(invoice|bill|receipt|challan)\b')::INT + regexp_matches(x, '(?i)\b(GST|VAT|tax)\b')::INT + regexp_matches(x, '(?i)\b(total|amount|payable|due)\b')::INT + regexp_matches(x, '(?i)\b(GSTIN|PAN|TAN)\b')::INT + regexp_matches(x, '(?i)₹|Rs\.?|INR')::INT + regexp_matches(x, '(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b')::INT AS k FROM t),
s AS (SELECT doc_id, CASE WHEN trim(x) = '' THEN 'OCR_FAILED' WHEN length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) / length(regexp_replace(x, '\s', '', 'g')) < 0.5 THEN 'UNREADABLE' WHEN k = 1 THEN 'UNKNOWN' WHEN k < 1 THEN 'NON_INVOICE'
  WHEN length(x) < 200 THEN 'LOW_TEXT' WHEN doc_id % 6 > 0 THEN 'MISSING_FIELDS' WHEN doc_id % 4 > 0 THEN 'VALIDATION_FAILED' ELSE 'READY' END AS status FROM n)"""
register("dec_doc_status", lambda s, d: _statused(s, d).select("doc_id", "status"), _STATUS + " SELECT doc_id, status FROM s")
register("agg_doc_status", lambda s, d: D.status_counts(_statused(s, d)), _STATUS + """
SELECT d.status, count(s.status) AS n FROM (VALUES ('OCR_FAILED'), ('UNREADABLE'), ('UNKNOWN'), ('NON_INVOICE'), ('LOW_TEXT'), ('MISSING_FIELDS'), ('VALIDATION_FAILED'), ('READY')) d(status) LEFT JOIN s ON s.status = d.status GROUP BY 1""")


def _bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills printed as text, a line per item and label: doc_id, line_no, text."""
    bills = _bills(spark, sf_dir)[0].filter("taxable_paise IS NOT NULL")
    money = lambda c: F.concat(F.expr(f"{c} div 100").cast("string"), F.lit("."), F.lpad(F.expr(f"{c} % 100").cast("string"), 2, "0"))
    again = F.when(F.col("doc") % 4 == 0, F.concat(F.lit("Total "), F.col("doc").cast("string"), F.lit(".00"))).otherwise(F.concat(F.lit("total: "), money("grand_paise")))
    lines = F.array(F.concat(F.lit("Bill "), "number"), F.lit("Supplier:"), F.lit("Sold by us"), F.lit("Buyer:"), F.lit("Someone"), F.concat(F.lit("Sub Total "), money("taxable_paise")), F.concat(F.lit("TOTAL "), money("grand_paise")), again, F.concat(F.lit("Grand Total Rs "), money("grand_paise")))
    return bills.select(F.col("doc").alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))


_LINES = """
WITH s AS (SELECT l_orderkey AS doc, sum(CASE WHEN l_linenumber <> 7 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END)::BIGINT AS sums FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
b AS (SELECT doc, sums + CASE WHEN doc % 7 = 0 THEN 500 ELSE 0 END AS taxable FROM s), t AS (SELECT *, CASE WHEN doc % 5 <> 0 THEN taxable * 9 // 100 * 2 ELSE 0 END AS tax FROM b),
bills AS (SELECT *, taxable + tax + CASE WHEN doc % 19 = 0 THEN 10000 ELSE 0 END AS grand FROM t WHERE taxable IS NOT NULL)"""
register("jn_label_amounts", lambda s, d: D.label_amounts(_bill_lines(s, d), ("TOTAL", "SUB TOTAL", "GRAND TOTAL", "GRAND TOTAL RS")), _LINES + """
SELECT doc AS doc_id, 5 AS line_no, 'SUB TOTAL' AS label, taxable AS value FROM bills UNION ALL SELECT doc, 6, 'TOTAL', grand FROM bills
UNION ALL SELECT doc, 7, 'TOTAL', CASE WHEN doc % 4 = 0 THEN doc * 100 ELSE grand END FROM bills UNION ALL SELECT doc, 8, 'GRAND TOTAL RS', grand FROM bills""")
register("agg_the_one", lambda s, d: D.the_one(D.label_amounts(_bill_lines(s, d), ("TOTAL", "SUB TOTAL", "GRAND TOTAL", "GRAND TOTAL RS")), ["doc_id", "label"]), _LINES + """
SELECT doc AS doc_id, 'SUB TOTAL' AS label, 1::BIGINT AS values, taxable AS value FROM bills UNION ALL SELECT doc, 'GRAND TOTAL RS', 1, grand FROM bills
UNION ALL SELECT doc, 'TOTAL', CASE WHEN doc % 4 = 0 AND doc * 100 <> grand THEN 2 ELSE 1 END, CASE WHEN doc % 4 = 0 AND doc * 100 <> grand THEN NULL ELSE grand END FROM bills""")
register("win_section", lambda s, d: D.sections(_bill_lines(s, d), {"supplier": "^Supplier:", "buyer": "^Buyer:"}).groupBy("doc_id").agg(F.count_if(F.col("section") == "supplier").alias("supplier"), F.count_if(F.col("section") == "buyer").alias("buyer"), F.count_if(F.col("section").isNull()).alias("before")), _LINES + " SELECT doc AS doc_id, 2::BIGINT AS supplier, 6::BIGINT AS buyer, 1::BIGINT AS before FROM bills")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, in the log's shape."""
    static = V.table(spark, sf_dir, "events")
    e = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream's plain path has to be a folder
    unknown = F.when(F.col("event_type") == "error", "unknown").otherwise("known")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).cast("string").alias("company_key"), F.when(F.col("event_type") == "click", "write_attempted").otherwise("other").alias("action"), unknown.alias("outcome"), F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("operation_id"))


def st_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark)
    state = S.claims(spark, f"{place}/claims")
    S.claim(_events(spark, sf_dir), state, f"{place}/checkpoint").awaitTermination()
    return state.read()


register("st_claim", st_claim, V.VIEWS + "SELECT company_key, operation_id, count(*) - 1 AS refused, min(seq) AS seq FROM action_log GROUP BY ALL")


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of four files, by time; one row in fifty comes with the last file, whenever it was written."""
    static = V.action_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ends = static.agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b")).first()
    path = folder(spark)
    nth = F.when(F.col("seq") % 50 == 0, 3).otherwise(F.expr(f"(unix_seconds(ts) - {ends['a'] or 0}) * 4 div {(ends['b'] or 0) - (ends['a'] or 0) + 1}"))
    for k in range(4):  # one file each, one after the other: a stream takes them in order of their times
        static.filter(nth == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _windows(spark: SparkSession, sf_dir: str, made) -> N.Windows:
    place = folder(spark)
    windows = made(spark, f"{place}/windows")
    windows.start(_parted(spark, sf_dir), f"{place}/checkpoint").awaitTermination()
    return windows


def st_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that have closed, and those that are open still."""
    w = _windows(spark, sf_dir, lambda s, p: N.metrics(s, p, late="6 hours", size="1 day"))
    rows = w.rows("closed").withColumn("closed", F.lit(True)).unionByName(w.rows("open").withColumn("closed", F.lit(False)))
    return rows.select("company_key", F.col("start").cast("string").alias("start"), "rows", "writes", "unknown", "closed")


def st_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came after their window had closed: how many, by company and day."""
    w = _windows(spark, sf_dir, lambda s, p: N.metrics(s, p, late="6 hours", size="1 day"))
    return w.rows("late").groupBy("company_key", F.date_trunc("day", "ts").cast("string").alias("start"), "batch").agg(F.count("*").alias("n"))


def st_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir, lambda s, p: N.sessions(s, p, gap="12 hours", late="6 hours"))
    rows = w.rows("closed").unionByName(w.rows("open"))
    return rows.groupBy("operation_id").agg(F.count("*").alias("sessions"), F.sum("lines").alias("lines"), F.max("lines").alias("longest"))


#: Rows with the batch that brings them and the watermark before it; a row is late if its window's end isn't beyond it.
_PARTED = V.VIEWS + """
, ends AS (SELECT min(floor(epoch(ts)))::BIGINT AS a, max(floor(epoch(ts)))::BIGINT AS b FROM action_log),
parted AS (SELECT l.*, CASE WHEN seq % 50 = 0 THEN 3 ELSE (floor(epoch(ts))::BIGINT - a) * 4 // (b - a + 1) END AS batch FROM action_log l, ends),
marks AS (SELECT batch, lag(high) OVER (ORDER BY batch) - INTERVAL 6 HOUR AS mark FROM (SELECT batch, max(max(ts)) OVER (ORDER BY batch) AS high FROM parted GROUP BY batch)),
final AS (SELECT max(ts) - INTERVAL 6 HOUR AS mark FROM parted)"""
_DAYS = _PARTED + """
, rows AS (SELECT p.*, date_trunc('day', ts) AS start, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM parted p JOIN marks USING (batch))"""
register("st_metrics", st_metrics, _DAYS + """
SELECT company_key, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows, count(*) FILTER (action = 'write_attempted') AS writes, count(*) FILTER (outcome = 'unknown') AS unknown,
  start + INTERVAL 1 DAY <= any_value(mark) AS closed FROM rows, final WHERE NOT late GROUP BY company_key, rows.start""")
register("st_late", st_late, _DAYS + " SELECT company_key, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, batch, count(*) AS n FROM rows WHERE late GROUP BY company_key, rows.start, batch")
register("st_session", st_session, _PARTED + """
, kept AS (SELECT operation_id, ts FROM parted JOIN marks USING (batch) WHERE NOT coalesce(ts + INTERVAL 12 HOUR <= mark, false)),
g AS (SELECT operation_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY operation_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM kept),
n AS (SELECT operation_id, sum(fresh) OVER (PARTITION BY operation_id ORDER BY ts) AS nth FROM g), s AS (SELECT operation_id, nth, count(*) AS lines FROM n GROUP BY ALL)
SELECT operation_id, count(*) AS sessions, sum(lines)::BIGINT AS lines, max(lines) AS longest FROM s GROUP BY 1""")
