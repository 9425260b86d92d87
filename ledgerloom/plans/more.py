"""Queries on scalars, laws, bands, calibration, and round trips through sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import money as M
from ..functions import text as X
from ..operators import audit as A
from ..operators import band as B
from ..operators import calibrate as K
from ..operators import checks as C
from ..operators import decide as D
from ..operators import evaluate as E
from ..shared import folder
from ..sources import books, spend
from . import views as V
from .evaluation import _BASE, RATE, SEED
from .ledger import LOOKUP

register("fn_clean", lambda s, d: V.vouchers(s, d).select("id", X.clean(F.concat(F.lit("  "), "narration", F.lit(" \t x "))).alias("text")), V.VIEWS + "SELECT id, narration || ' x' AS text FROM vouchers")
register("fn_rate_qty", lambda s, d: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.basis_points(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(".5 %"))).alias("rate"), M.thousandths(F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") == 1, ".12345").otherwise(".25"))).alias("quantity")),
         "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_discount * 100) AS BIGINT) * 100 + 50 AS rate, CASE WHEN l_linenumber <> 1 THEN CAST(l_quantity AS BIGINT) * 1000 + 250 END AS quantity FROM lineitem")


def fn_gstin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    text = F.concat(F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0"), F.lit("abcde"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.when(F.col("c_custkey") % 9 == 0, "1").otherwise("f"), F.lit("1z5"))
    return c.select("c_custkey", M.tax_id(text).alias("tax_id"), F.substring(M.tax_id(text), 1, 2).alias("state"))


register("fn_gstin", fn_gstin, """
WITH t AS (SELECT c_custkey, lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' AS x FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN x END AS tax_id, CASE WHEN c_custkey % 9 <> 0 THEN left(x, 2) END AS state FROM t""")


def fn_hsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    code = M.goods_code(F.concat(F.when(F.col("p_partkey") % 4 == 0, "99").otherwise(""), (F.col("p_partkey") * 37 % 100000000).cast("string")))
    return p.select("p_partkey", code["code"].alias("code"), code["kind"].alias("kind"))


register("fn_hsn", fn_hsn, """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '99' ELSE '' END || (p_partkey * 37 % 100000000) AS x FROM part)
SELECT p_partkey, CASE WHEN length(x) IN (4, 6, 8) THEN x END AS code, CASE WHEN length(x) IN (4, 6, 8) THEN CASE WHEN x LIKE '99%' THEN 'SAC' ELSE 'HSN' END END AS kind FROM t""")
register("fn_crore", lambda s, d: V.vouchers(s, d).select("id", M.crore(F.when(F.col("amount_paise") % 3 == 0, F.col("amount_paise")).otherwise(F.col("amount_paise") * 10_000_000)).alias("crore")), V.VIEWS + """
, p AS (SELECT id, CASE WHEN amount_paise % 3 = 0 THEN amount_paise ELSE amount_paise * 10000000 END AS p FROM vouchers)
SELECT id, CASE WHEN p % 10000000 = 0 THEN (p // 1000000000) || '.' || lpad(CAST(p // 10000000 % 100 AS VARCHAR), 2, '0') END AS crore FROM p""")
register("fn_confidence", lambda s, d: V.vouchers(s, d).select("id", B.confidence(F.array(F.col("amount_paise") % 103, F.lit(90).cast("bigint")), F.col("gst_paise").isNotNull()).alias("confidence")), V.VIEWS + """
SELECT id, CASE WHEN amount_paise % 103 > 100 THEN NULL WHEN gst_paise IS NULL THEN 0.0 ELSE least(amount_paise % 103, 90) / 100 END::DOUBLE AS confidence FROM vouchers""")


def chk_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of vouchers, some of which break a law or lack a side of it."""
    v = V.vouchers(spark, sf_dir)
    a = F.col("amount_paise")
    none = F.lit(None).cast("bigint")
    lines = F.when(a % 7 == 0, F.lit(None).cast("array<bigint>")).when(a % 8 == 0, F.array(a, F.lit(1).cast("bigint"))).when(a % 9 == 0, F.array(a, none)).otherwise(F.array(a - 10, F.lit(10).cast("bigint")))
    rows = v.select(
        "id", a.alias("debits"), F.when(a % 5 == 0, a + 1).when(a % 31 == 0, none).otherwise(a).alias("credits"), lines.alias("lines"), F.when(a % 29 == 0, none).otherwise(a).alias("total"), (a - 1).alias("net"),
        F.when(a % 2 == 0, a % 3).alias("tax"), a.alias("gross"), F.when(a % 37 != 0, F.lit(0).cast("bigint")).alias("before"), a.alias("after"), F.when(a % 3 == 0, F.lit(0).cast("bigint")).otherwise(a).alias("entry"),
    )
    return C.conservation(rows)


register("chk_conservation", chk_conservation, V.VIEWS + """
, f AS (SELECT id, amount_paise AS a, CASE WHEN amount_paise % 5 = 0 THEN amount_paise + 1 WHEN amount_paise % 31 = 0 THEN NULL ELSE amount_paise END AS credits,
  CASE WHEN amount_paise % 7 = 0 THEN NULL WHEN amount_paise % 8 = 0 THEN [amount_paise, 1] WHEN amount_paise % 9 = 0 THEN [amount_paise, NULL] ELSE [amount_paise - 10, 10] END AS lines, CASE WHEN amount_paise % 29 <> 0 THEN amount_paise END AS total,
  amount_paise - 1 AS net, CASE WHEN amount_paise % 2 = 0 THEN amount_paise % 3 END AS tax, CASE WHEN amount_paise % 37 <> 0 THEN 0 END AS before, CASE WHEN amount_paise % 3 = 0 THEN 0 ELSE amount_paise END AS entry FROM vouchers),
l AS (SELECT id, 'debits_equal_credits' AS law, a = credits AS holds FROM f UNION ALL SELECT id, 'lines_sum_to_total', CASE WHEN len(list_filter(lines, lambda x: x IS NULL)) = 0 THEN list_sum(lines) = total END FROM f
  UNION ALL SELECT id, 'net_plus_tax_is_gross', net + tax = a FROM f UNION ALL SELECT id, 'balance_moves_by_entry', a - before = entry FROM f)
SELECT id, law, CASE WHEN holds IS NULL THEN 'INDETERMINATE' WHEN holds THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l""")


def dec_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vouchers with facts of every kind: each reason to block, and each to ask, stands somewhere, alone and with others."""
    v = V.vouchers(spark, sf_dir)
    a, none = F.col("amount_paise"), F.lit(None)
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rows = v.select(
        "id", F.when(a % 11 == 0, words("PASS", "FAIL")).when(a % 17 == 0, words("INDETERMINATE")).otherwise(words("PASS")).alias("laws"), a.alias("checked_paise"), F.when(a % 23 == 0, a + 1).when(a % 29 == 0, none).otherwise(a).alias("written_paise"),
        F.when(a % 31 != 0, a % 6).alias("asked"), F.when(a % 4 == 0, F.lit(True)).when(a % 9 != 0, F.lit(False)).alias("has_tax"), (a % 10 == 3).alias("tax_read"), F.when(a % 41 != 0, a % 37 != 0).alias("period_open"), (a % 13 != 0).alias("party_known"),
        F.when(a % 19 == 0, "").when(a % 43 == 0, F.col("credit_account")).otherwise(F.col("debit_account")).alias("debit_account"), F.when(a % 47 != 0, F.col("credit_account")).alias("credit_account"),
        F.when(a % 53 != 0, 0.99).alias("amount_confidence"), ((100 - a % 50) / 100).alias("party_confidence"), F.lit(0.6).alias("tax_confidence"), F.when(a % 7 == 0, 0.8).otherwise(0.99).alias("date_confidence"),
        F.element_at(words("invoice", "receipt", "credit_note", "typed_expense_note"), (a % 4 + 1).cast("int")).alias("kind"), (a % 59 == 0).alias("repaired"),
        F.when(a % 61 == 0, words()).when(a % 2 == 0, words("typed_text")).when(a % 3 == 0, words("pdf_text_layer", "picture")).otherwise(words("pdf_text_layer")).alias("tiers"), (a % 67 == 0).alias("needs_person"), F.when(a % 71 == 0, 2).otherwise(0).alias("ambiguous"),
    )
    return B.decided(rows).select("id", "band", F.array_join("reasons", "; ").alias("reasons"))


#: The laws of the band, over the same facts: a reason and when it stands, those that block first.
_BLOCKS = (
    ("a law can''t be told", "list_contains(laws, 'INDETERMINATE')"), ("a law fails", "list_contains(laws, 'FAIL')"), ("the amount checked isn''t the amount written", "checked IS DISTINCT FROM written"), ("too many questions", "asked >= 5"),
    ("tax isn''t ruled out", "has_tax IS NOT false"), ("tax was read where there is none", "has_tax IS false AND tax_read"), ("the period isn''t open", "open IS NOT true"), ("the party isn''t known", "known IS NOT true"),
    ("both legs are one account", "debit <> '' AND debit = credit"), ("a field is too uncertain", "low < 0.70"),
)
_ASKS = (
    ("the file was repaired", "a % 59 = 0"), ("a field was read inexactly", "len(tiers) = 0 OR len(list_filter(tiers, lambda t: t NOT IN ('pdf_text_layer', 'typed_text'))) > 0"), ("the kind needs a person", "a % 67 = 0"), ("a field is ambiguous", "a % 71 = 0"),
    ("a field is uncertain", "low < 0.95"), ("a leg is missing", "coalesce(debit, '') = '' OR coalesce(credit, '') = ''"),
)
_said = lambda laws: "list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{reason}' END" for reason, when in laws) + "], lambda x: x IS NOT NULL)"
register("dec_band", dec_band, V.VIEWS + f"""
, f AS (SELECT id, amount_paise AS a, CASE WHEN amount_paise % 11 = 0 THEN ['PASS', 'FAIL'] WHEN amount_paise % 17 = 0 THEN ['INDETERMINATE'] ELSE ['PASS'] END AS laws, amount_paise AS checked, CASE WHEN amount_paise % 23 = 0 THEN amount_paise + 1 WHEN amount_paise % 29 = 0 THEN NULL ELSE amount_paise END AS written,
  CASE WHEN amount_paise % 31 <> 0 THEN amount_paise % 6 END AS asked, CASE WHEN amount_paise % 4 = 0 THEN true WHEN amount_paise % 9 <> 0 THEN false END AS has_tax, amount_paise % 10 = 3 AS tax_read, CASE WHEN amount_paise % 41 <> 0 THEN amount_paise % 37 <> 0 END AS open, amount_paise % 13 <> 0 AS known,
  CASE WHEN amount_paise % 19 = 0 THEN '' WHEN amount_paise % 43 = 0 THEN credit_account ELSE debit_account END AS debit, CASE WHEN amount_paise % 47 <> 0 THEN credit_account END AS credit, (['invoice', 'receipt', 'credit_note', 'typed_expense_note'])[amount_paise % 4 + 1] AS kind,
  CASE WHEN amount_paise % 61 = 0 THEN [] WHEN amount_paise % 2 = 0 THEN ['typed_text'] WHEN amount_paise % 3 = 0 THEN ['pdf_text_layer', 'picture'] ELSE ['pdf_text_layer'] END AS tiers FROM vouchers),
c AS (SELECT *, least(CASE WHEN a % 53 <> 0 THEN 0.99::DOUBLE END, (100 - a % 50)::DOUBLE / 100::DOUBLE, CASE WHEN has_tax IS NOT false THEN 0.6::DOUBLE END, CASE WHEN kind IN ('invoice', 'credit_note') THEN CASE WHEN a % 7 = 0 THEN 0.8::DOUBLE ELSE 0.99::DOUBLE END END) AS low FROM f),
r AS (SELECT id, {_said(_BLOCKS)} AS block, {_said(_ASKS)} AS ask FROM c)
SELECT id, CASE WHEN len(block) > 0 THEN 'BLOCK' WHEN len(ask) > 0 THEN 'ASK' ELSE 'POST' END AS band, array_to_string(list_concat(block, ask), '; ') AS reasons FROM r""")


def dec_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("amount_paise")
    rows = V.vouchers(spark, sf_dir).select("id", F.when(a % 3 == 0, "VALID").when(a % 3 == 1, "UNCLEAR").otherwise("NOT_VALID").alias("outcome"), F.when(a % 4 == 0, "BLOCK").when(a % 4 == 1, "ASK").otherwise("POST").alias("band"))
    return D.narrowed(rows)


register("dec_narrow", dec_narrow, V.VIEWS + """
, r AS (SELECT id, CASE amount_paise % 3 WHEN 0 THEN 'VALID' WHEN 1 THEN 'UNCLEAR' ELSE 'NOT_VALID' END AS o, CASE amount_paise % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ASK' ELSE 'POST' END AS band FROM vouchers)
SELECT id, CASE WHEN o <> 'VALID' THEN o WHEN band = 'BLOCK' THEN 'NOT_VALID' WHEN band = 'ASK' THEN 'UNCLEAR' ELSE 'VALID' END AS outcome, band FROM r""")


def agg_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings chosen on the calibration half of the companies; counts come from one pass over all entries."""
    history, entries = V.book(spark, sf_dir, ("party", "debit_account", "amount_paise", "gst_paise"))
    rows = K.calibrate(K.fired(entries, history))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "detector string, setting int, kept boolean, flagged long, clean long, held_flagged long, held_clean long")


#: Levels per entry, counted by half; then detector by detector the most sensitive setting whose union with those before stays inside the target.
_CALIBRATE = LOOKUP + """
, days AS (SELECT company_key, debit_account, date, max(amount_paise) AS high, count(*) AS n FROM history GROUP BY ALL),
up AS (SELECT e.company_key, e.id, any_value(e.amount_paise) AS a, sum(d.n) AS seen, max(d.high) AS high FROM entries e JOIN days d ON d.company_key = e.company_key AND d.debit_account = e.debit_account AND d.date < e.date GROUP BY ALL),
tx AS (SELECT company_key, debit_account, max(coalesce(gst_paise, 0)) AS most FROM history GROUP BY ALL),
hv AS (SELECT company_key, CASE WHEN row_number() OVER (ORDER BY company_key) % 2 = 1 THEN 'calibration' ELSE 'held_out' END AS half FROM (SELECT DISTINCT company_key FROM entries)),
lv AS (SELECT hv.half, CASE WHEN s.status = 'match' AND s.usual <> s.debit_account THEN len(list_filter([1, 2, 3, 4, 5], lambda x: x <= s.most)) ELSE 0 END AS vs, (tx.most IS NULL)::INT AS fu,
    CASE WHEN up.seen >= 2 THEN len(list_filter([100, 150, 200, 300, 500, 1000, 1500], lambda x: up.a * 100 > up.high * x)) ELSE 0 END AS mg, (coalesce(s.gst_paise, 0) <> 0 AND coalesce(tx.most = 0, false))::INT AS ga
  FROM seen s JOIN hv ON hv.company_key = s.company_key LEFT JOIN up ON up.company_key = s.company_key AND up.id = s.id LEFT JOIN tx ON tx.company_key = s.company_key AND tx.debit_account = s.debit_account),
c AS (SELECT half, vs, fu, mg, ga, count(*) AS n FROM lv GROUP BY ALL), t AS (SELECT half, sum(n)::BIGINT AS n FROM c GROUP BY 1),
k1 AS (SELECT min(k) AS k FROM (SELECT k, (SELECT coalesce(sum(n), 0) FROM c WHERE half = 'calibration' AND vs > k) AS f FROM unnest(range(0, 5)) u(k)) WHERE f * 100 <= 10 * (SELECT n FROM t WHERE half = 'calibration')),
k2 AS (SELECT min(k) AS k FROM (SELECT k, (SELECT coalesce(sum(n), 0) FROM c WHERE half = 'calibration' AND (vs > (SELECT coalesce(k, 99) FROM k1) OR fu > k)) AS f FROM unnest(range(0, 1)) u(k)) WHERE f * 100 <= 10 * (SELECT n FROM t WHERE half = 'calibration')),
k3 AS (SELECT min(k) AS k FROM (SELECT k, (SELECT coalesce(sum(n), 0) FROM c WHERE half = 'calibration' AND (vs > (SELECT coalesce(k, 99) FROM k1) OR fu > (SELECT coalesce(k, 99) FROM k2) OR mg > k)) AS f FROM unnest(range(0, 7)) u(k)) WHERE f * 100 <= 10 * (SELECT n FROM t WHERE half = 'calibration')),
k4 AS (SELECT min(k) AS k FROM (SELECT k, (SELECT coalesce(sum(n), 0) FROM c WHERE half = 'calibration' AND (vs > (SELECT coalesce(k, 99) FROM k1) OR fu > (SELECT coalesce(k, 99) FROM k2) OR mg > (SELECT coalesce(k, 99) FROM k3) OR ga > k)) AS f FROM unnest(range(0, 1)) u(k)) WHERE f * 100 <= 10 * (SELECT n FROM t WHERE half = 'calibration')),
o AS (SELECT 'vendor_switch' AS detector, [1, 2, 3, 4, 5] AS grid, k FROM k1 UNION ALL SELECT 'first_use', [0], k FROM k2 UNION ALL SELECT 'magnitude', [100, 150, 200, 300, 500, 1000, 1500], k FROM k3 UNION ALL SELECT 'gst_anomaly', [0], k FROM k4),
p AS (SELECT *, coalesce(k, len(grid) - 1) AS pos FROM o),
w AS (SELECT p.*, c.half, c.n, CASE detector WHEN 'vendor_switch' THEN vs WHEN 'first_use' THEN fu WHEN 'magnitude' THEN mg ELSE ga END > pos AS hit FROM p, c)
SELECT detector, any_value(grid[pos + 1]) AS setting, any_value(k IS NOT NULL) AS kept, coalesce(sum(n) FILTER (half = 'calibration' AND hit), 0)::BIGINT AS flagged, sum(n) FILTER (half = 'calibration')::BIGINT AS clean,
  coalesce(sum(n) FILTER (half = 'held_out' AND hit), 0)::BIGINT AS held_flagged, sum(n) FILTER (half = 'held_out')::BIGINT AS held_clean FROM w GROUP BY detector"""
register("agg_calibrate", agg_calibrate, _CALIBRATE)


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vouchers of part of the suppliers, published as CSV files with two kinds of header, and read back."""
    v = V.vouchers(spark, sf_dir)
    a = F.col("amount_paise")
    money = F.concat(F.when(a % 4 == 0, "-£").otherwise("£"), F.format_number(a / 100, 2))
    rows = v.select(F.col("id"), F.date_format("date", "dd/MM/yyyy").alias("when"), F.when(a % 9 == 0, "").otherwise(F.col("party")).alias("who"), F.col("debit_account").alias("what"), F.col("narration").alias("why"), F.when(a % 10 == 0, "n/a").otherwise(money).alias("money"))
    one, two = folder(spark), folder(spark)
    rows.filter(a % 2 == 0).select(F.col("when").alias("Date"), F.col("who").alias("Supplier"), F.col("what").alias("Expense type"), F.col("why").alias("Description"), F.col("money").alias("Amount"), F.col("id").alias("Reference")).write.option("header", True).option("emptyValue", "").csv(one)
    rows.filter(a % 2 == 1).select(F.col("id").alias("Reference"), F.col("money").alias(" £ "), F.col("why").alias("Item Text"), F.col("what").alias("Expense Type"), F.col("who").alias("Supplier "), F.col("when").alias("Date of Payment")).write.option("header", True).option("emptyValue", "").csv(two)
    return spend.load(spend.read_files(spark, [f"{one}/*.csv", f"{two}/*.csv"]))


_SPEND = V.VIEWS + "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN amount_paise % 9 = 0 THEN '' ELSE party END AS party, narration, debit_account AS account, CASE WHEN amount_paise % 10 = 0 THEN NULL WHEN amount_paise % 4 = 0 THEN -amount_paise ELSE amount_paise END AS amount, concat_ws('; ', CASE WHEN amount_paise % 9 = 0 THEN 'party is empty' END, CASE WHEN amount_paise % 10 = 0 THEN 'amount is unreadable' END) AS reasons FROM vouchers"
register("src_spend_csv", lambda s, d: _spend(s, d).filter(F.size("reasons") == 0).select(F.col("date").cast("string").alias("date"), "party", "narration", "account", "amount"), f"SELECT date, party, narration, account, amount FROM ({_SPEND}) WHERE reasons = ''")
register("src_quarantine", lambda s, d: _spend(s, d).filter(F.size("reasons") > 0).select(F.col("date").cast("string").alias("date"), "party", "narration", "account", "amount", F.array_join("reasons", "; ").alias("reasons")), f"SELECT * FROM ({_SPEND}) WHERE reasons <> ''")


def agg_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spend.report(_spend(spark, sf_dir))
    return rows.agg(F.sum("rows").alias("rows"), F.sum("loaded").alias("loaded"), F.sum("rejected").alias("rejected"), F.sum("refunds").alias("refunds"), F.sum(F.coalesce(F.col("by_reason")["party is empty"], F.lit(0))).alias("no_party"), F.sum(F.coalesce(F.col("by_reason")["amount is unreadable"], F.lit(0))).alias("no_amount"))


register("agg_load_report", agg_load_report, f"SELECT count(*) AS rows, count(*) FILTER (reasons = '') AS loaded, count(*) FILTER (reasons <> '') AS rejected, count(*) FILTER (reasons = '' AND amount < 0) AS refunds, count(*) FILTER (party = '') AS no_party, count(*) FILTER (amount IS NULL) AS no_amount FROM ({_SPEND})")


def snk_action_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    log = V.action_log(spark, sf_dir).withColumn("actor", F.when(F.col("seq") % 3 == 0, "not recorded").otherwise(F.col("company_key")))
    books.append_actions(log.filter("seq % 2 = 0"), path)
    books.append_actions(log.filter("seq % 2 = 1"), path)
    return books.actions(spark, path).groupBy("actor").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


register("snk_action_append", snk_action_append, V.VIEWS + "SELECT CASE WHEN seq % 3 = 0 THEN 'not recorded' ELSE company_key END AS actor, count(*) AS n, max(seq) AS last FROM action_log GROUP BY 1")


def snk_book_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corrupted book and its answer key, written apart and read back."""
    path = folder(spark)
    entries = V.Book(spark, sf_dir, ("party", "narration", "debit_account", "credit_account", "amount_paise", "gst_paise")).entries
    vouchers, truth = E.inject(entries.drop("seq"), RATE, SEED, exact=False)  # the pair of date and id, which travel anyway
    books.write_book(vouchers.withColumn("seq", F.struct("date", "id")), truth, path, "gzip")
    back = spark.read.schema("company_key string, id string, amount_paise bigint, gst_paise bigint").json(f"{path}/vouchers")
    key = spark.read.schema("company_key string, id string, error_type string, field string, was string, now string").json(f"{path}/truth")
    per = back.groupBy("company_key").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount"), F.count("gst_paise").alias("taxed"))
    return per.join(key.groupBy("company_key").agg(F.count("*").alias("errors"), F.count_if(F.col("was") == "none").alias("claims")), "company_key", "left")


register("snk_book_jsonl", snk_book_jsonl, _BASE + " SELECT company_key, count(*) AS n, sum(amount_paise)::BIGINT AS amount, count(gst_paise) AS taxed, count(error_type) AS errors, count(*) FILTER (error_type = 'gst_anomaly') AS claims FROM entries GROUP BY 1")


def jn_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent against stored vouchers: the fields that differ, null-safe; a missing one is absent."""
    v = V.vouchers(spark, sf_dir)
    a = F.col("amount_paise")
    stored = v.filter(a % 50 != 0).select("id", F.when(a % 21 == 0, F.lit("?")).otherwise(F.col("party")).alias("s_party"), F.when(a % 33 == 0, a + 1).otherwise(a).alias("s_amount"), F.when(a % 40 == 0, F.lit(None)).otherwise(F.col("gst_paise")).alias("s_gst"), F.lit(True).alias("there"))
    both = v.join(stored, "id", "left")
    wrong = F.array_compact(F.array(F.when(~F.col("party").eqNullSafe(F.col("s_party")), "party"), F.when(~F.col("amount_paise").eqNullSafe(F.col("s_amount")), "amount"), F.when(~F.col("gst_paise").eqNullSafe(F.col("s_gst")), "tax")))
    said = F.when(F.col("there").isNull(), "absent").otherwise(F.array_join(wrong, ","))
    return both.select("id", said.alias("differs")).filter("differs <> ''")


register("jn_readback", jn_readback, V.VIEWS + """
, d AS (SELECT id, CASE WHEN amount_paise % 50 = 0 THEN 'absent' ELSE concat_ws(',', CASE WHEN amount_paise % 21 = 0 THEN 'party' END, CASE WHEN amount_paise % 33 = 0 THEN 'amount' END, CASE WHEN amount_paise % 40 = 0 AND gst_paise IS NOT NULL THEN 'tax' END) END AS differs FROM vouchers)
SELECT id, differs FROM d WHERE differs <> ''""")


def agg_batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.action_log(spark, sf_dir)
    states = log.select((F.col("seq") % 500).cast("string").alias("batch_id"), F.when(F.col("seq") % 97 == 0, "UNKNOWN").when(F.col("seq") % 31 == 0, "PARTIAL").otherwise("COMPLETED").alias("state"))
    accounted = V.table(spark, sf_dir, "events").select((F.col("event_id") % 500).cast("string").alias("batch_id")).distinct().withColumn("accounted", F.col("batch_id").cast("int") % 4 != 0)
    return A.batch_state(states, ("UNKNOWN", "PARTIAL", "COMPLETED"), accounted)


register("agg_batch_state", agg_batch_state, """
WITH s AS (SELECT event_id % 500 AS b, min(CASE WHEN event_id % 97 = 0 THEN 1 WHEN event_id % 31 = 0 THEN 2 ELSE 3 END) AS r FROM events GROUP BY 1)
SELECT CAST(b AS VARCHAR) AS batch_id, CASE WHEN r = 1 THEN 'UNKNOWN' WHEN r = 2 THEN 'PARTIAL' WHEN b % 4 = 0 THEN 'CRITICAL_FAILURE' ELSE 'COMPLETED' END AS state FROM s""")
