"""Queries on names, amounts, history, checks, detectors and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import money as M
from ..functions import text as X
from ..operators import checks as C
from ..operators import decide as D
from ..operators import detect as T
from ..operators import history as H
from . import views as V

NAMES = V.NAMES.replace("{rows}", "vouchers")
HISTORY = V.NAMES.replace("{rows}", "history")


def fn_text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vouchers(spark, sf_dir).select("id", X.folded(F.col("party")).alias("folded"))


register("fn_text_fold", fn_text_fold, NAMES + "SELECT id, f AS folded FROM folded")


def fn_split_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.supplier_name(F.col("party"))
    return V.vouchers(spark, sf_dir).select("party").distinct().select("party", n["stem"].alias("stem"), n["form"].alias("form"))


register("fn_split_supplier", fn_split_supplier, NAMES + "SELECT DISTINCT party, stem, form FROM named")


def fn_vendor_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vouchers(spark, sf_dir).select("id", X.vendor_key(F.col("party")).alias("vendor_key"))


register("fn_vendor_key", fn_vendor_key, NAMES + "SELECT id, vendor_key FROM keyed")


def fn_phrase_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("narration", F.lit(f" [{X.MARKER}:op_"), F.col("amount_paise").cast("string"), F.lit("] & Co."))
    return V.vouchers(spark, sf_dir).select("id", X.phrase_key(marked).alias("phrase"))


register("fn_phrase_key", fn_phrase_key, V.VIEWS + r"""
SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(lower(narration || ' & Co.'), '[0-9]+', ' ', 'g'), '[^a-z_\s&]', ' ', 'g')), '\s+', '_', 'g') AS phrase FROM vouchers""")


def fn_company_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.company_key(F.concat("c_name", F.lit(" (North) "), "c_mktsegment")).alias("company_key"))


register("fn_company_key", fn_company_key, r"""SELECT c_custkey, regexp_replace(trim(regexp_replace(lower(c_name || ' (North) ' || c_mktsegment), '[^a-z0-9_\s]', ' ', 'g')), '\s+', '_', 'g') AS company_key FROM customer""")


def fn_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    once = X.stamped(F.col("narration"), F.concat(F.lit("op-"), "id"))
    return v.select("id", once.alias("stamped")).select("id", "stamped", X.operation_in(F.col("stamped")).alias("operation_id"), X.stamped(F.col("stamped"), F.concat(F.lit("op-"), "id")).alias("again"))


register("fn_marker", fn_marker, V.VIEWS + f"SELECT id, narration || ' [{X.MARKER}:op-' || id || ']' AS stamped, 'op-' || id AS operation_id, narration || ' [{X.MARKER}:op-' || id || ']' AS again FROM vouchers")


def fn_format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    signed = F.when(F.col("gst_paise").isNull(), -F.col("amount_paise")).otherwise(F.col("amount_paise") * 1000)
    return v.select("id", M.formatted(signed).alias("text"))


register("fn_format_money", fn_format_money, V.VIEWS + r"""
, a AS (SELECT id, CASE WHEN gst_paise IS NULL THEN -amount_paise ELSE amount_paise * 1000 END AS p FROM vouchers),
w AS (SELECT id, p, CAST(abs(p) // 100 AS VARCHAR) AS d FROM a)
SELECT id, '₹' || CASE WHEN p < 0 THEN '-' ELSE '' END
  || CASE WHEN length(d) <= 3 THEN d ELSE reverse(regexp_replace(regexp_replace(reverse(left(d, length(d) - 3)), '([0-9]{2})', '\1,', 'g'), ',$', '')) || ',' || right(d, 3) END
  || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS text FROM w""")


def fn_parse_pence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    text = F.concat(F.when(F.col("gst_paise").isNull(), " -£").otherwise("£"), F.format_number(F.col("amount_paise") / 100, 2), F.when(F.col("amount_paise") % 7 == 0, "5").otherwise(""))
    return v.select("id", M.pence(text).alias("pence"))


register("fn_parse_pence", fn_parse_pence, V.VIEWS + "SELECT id, CASE WHEN amount_paise % 7 = 0 THEN NULL WHEN gst_paise IS NULL THEN -amount_paise ELSE amount_paise END AS pence FROM vouchers")


def fn_parse_spend_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    text = F.when(F.col("amount_paise") % 3 == 0, F.date_format("date", "dd/MM/yyyy")).when(F.col("amount_paise") % 3 == 1, F.date_format("date", "d-MMM-yy")).otherwise(F.concat(F.lit("31/02/"), F.year("date").cast("string")))
    return v.select("id", M.spend_date(text).cast("string").alias("date"))


register("fn_parse_spend_date", fn_parse_spend_date, V.VIEWS + "SELECT id, CAST(CASE WHEN amount_paise % 3 = 0 THEN date WHEN amount_paise % 3 = 1 THEN (date - ((CAST(year(date) AS INTEGER) // 100 * 100 - 2000) * INTERVAL 1 YEAR))::DATE END AS VARCHAR) AS date FROM vouchers")


def fn_gst_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    signed = F.when(F.col("gst_paise").isNull(), -F.col("amount_paise")).otherwise(F.col("amount_paise"))
    return v.select("id", M.tax_inside(signed, F.lit(1800)).alias("tax"))


register("fn_gst_inside", fn_gst_inside, V.VIEWS + "SELECT id, CAST(floor(CAST(p AS DECIMAL(38, 0)) * 1800 / 11800) AS BIGINT) AS tax FROM (SELECT id, CASE WHEN gst_paise IS NULL THEN -amount_paise ELSE amount_paise END AS p FROM vouchers)")


def fn_scaled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = V.vouchers(spark, sf_dir).groupBy("company_key").agg(F.count_if(F.col("gst_paise").isNull()).alias("n"), F.count("*").alias("d"))
    return per.select("company_key", M.scaled_rate(F.col("n"), F.col("d"), 10000).alias("rate"), M.scaled_rate(F.col("n"), F.lit(0), 10000).alias("unmeasured"))


register("fn_scaled_rate", fn_scaled_rate, V.VIEWS + "SELECT company_key, (2 * 10000 * count(*) FILTER (gst_paise IS NULL) + count(*)) // (2 * count(*)) AS rate, CAST(NULL AS BIGINT) AS unmeasured FROM vouchers GROUP BY company_key")


def fn_legible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(X.legible(F.col("text")), 6).alias("share"))


register("fn_legible", fn_legible, r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 6) AS share FROM documents")


def chk_vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = V.Book(spark, sf_dir, ("party", "debit_account", "credit_account", "amount_paise", "gst_paise"))
    return C.run(book.rows, book.chart)


register("chk_vouchers", chk_vouchers, V.VIEWS + """
, k AS (SELECT v.*, d.account IS NOT NULL AS dk, c.account IS NOT NULL AS ck FROM vouchers v LEFT JOIN chart d ON d.company_key = v.company_key AND d.account = v.debit_account
        LEFT JOIN chart c ON c.company_key = v.company_key AND c.account = v.credit_account)
SELECT company_key, id, unnest(['amount_is_positive', 'amount_is_integer_paise', 'accounts_differ', 'accounts_exist', 'funding_is_named', 'gst_not_larger_than_amount', 'tax_lines_can_be_posted', 'party_is_named']) AS name,
  unnest([amount_paise > 0, amount_paise IS NOT NULL, debit_account <> credit_account, dk AND ck, credit_account <> '', coalesce(gst_paise, 0) <= amount_paise, gst_paise IS NULL, trim(party) <> '']) AS passed FROM k""")


def jn_accounts_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = V.Book(spark, sf_dir, ("debit_account", "credit_account"))
    return H.missing_accounts(book.rows, book.chart)


register("jn_accounts_exist", jn_accounts_exist, V.VIEWS + """
, l AS (SELECT company_key, id, 'debit' AS side, debit_account AS account FROM vouchers UNION ALL SELECT company_key, id, 'credit', credit_account FROM vouchers)
SELECT company_key, id, side, account FROM l WHERE NOT EXISTS (SELECT 1 FROM chart c WHERE c.company_key = l.company_key AND c.account = l.account)""")


def agg_vendor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = H.vendor_index(V.book(spark, sf_dir, ("party", "debit_account"))[0])
    return index.select("company_key", "vendor_key", "account", "times", "raw")


INDEX = HISTORY + """
, pairs AS (SELECT company_key, stem, form, vendor_key, debit_account AS account, count(*) AS times FROM keyed WHERE vendor_key <> '' GROUP BY ALL),
raws AS (SELECT company_key, vendor_key, arg_min(party, seq) AS raw FROM keyed GROUP BY ALL)"""
register("agg_vendor_index", agg_vendor_index, INDEX + " SELECT company_key, vendor_key, account, times, raw FROM pairs JOIN raws USING (company_key, vendor_key)")


def agg_vendor_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings behind each index row, in published order."""
    found = H.sources(V.book(spark, sf_dir, ("party", "debit_account"), numbered=True)[0], every=1000)
    return found.select("company_key", "vendor_key", "account", "chunk", F.sha2(F.array_join("ids", ","), 256).alias("ids"))


register("agg_vendor_sources", agg_vendor_sources, HISTORY + " SELECT company_key, vendor_key, debit_account AS account, (seq - 1) // 1000 AS chunk, sha256(string_agg(id, ',' ORDER BY seq)) AS ids FROM keyed WHERE vendor_key <> '' GROUP BY ALL")


def agg_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.phrase_index(V.book(spark, sf_dir, ("narration", "debit_account"))[0]).select("company_key", "phrase", "account", "times", "raw")


PHRASES = V.VIEWS + r"""
, p AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(lower(narration), '[0-9]+', ' ', 'g'), '[^a-z_\s&]', ' ', 'g')), '\s+', '_', 'g') AS phrase FROM history),
r AS (SELECT company_key, phrase, arg_min(narration, seq) AS raw FROM p GROUP BY ALL)"""
register("agg_phrase_index", agg_phrase_index, PHRASES + " SELECT company_key, phrase, debit_account AS account, count(*) AS times, any_value(raw) AS raw FROM p JOIN r USING (company_key, phrase) GROUP BY company_key, phrase, debit_account")


def _looked_up(book: V.Book) -> DataFrame:
    return H.lookup(H.with_vendor(book.entries), H.vendor_index(book.history), ["stem", "form", "vendor_key"])


def jn_vendor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(V.Book(spark, sf_dir, ("vendor", "party", "debit_account"))).select("company_key", "id", "status", F.array_join("accounts", ",").alias("accounts"))


LOOKUP = INDEX + """
, ranked AS (SELECT company_key, vendor_key, string_agg(account, ',' ORDER BY times DESC, account) AS accounts, count(*) AS n, max(times) AS most, arg_max(account, times) AS usual FROM pairs GROUP BY ALL)
, e0 AS (SELECT * FROM entries)
, ef AS (SELECT *, trim(regexp_replace(lower(party), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f FROM e0)
, es AS (SELECT *, CASE WHEN regexp_matches(f, '^m s .') THEN substr(f, 5) ELSE f END AS p FROM ef)
, en AS (SELECT *, CASE WHEN regexp_matches(p, ' pvt ltd$') THEN 'pvt_ltd' WHEN regexp_matches(p, ' (ltd|limited)$') THEN 'ltd' WHEN regexp_matches(p, ' co$') THEN 'and_co' ELSE '' END AS form,
    regexp_replace(p, ' (pvt ltd|ltd|limited|co)$', '') AS stem FROM es)
, ek AS (SELECT *, concat_ws('_', replace(stem, ' ', '_'), nullif(form, '')) AS vendor_key FROM en)
, seen AS (SELECT e.*, coalesce(r.accounts, '') AS accounts, r.most, r.usual, CASE WHEN r.n IS NULL THEN 'no_match' WHEN r.n = 1 THEN 'match' ELSE 'conflicted' END AS status
           FROM ek e LEFT JOIN ranked r ON r.company_key = e.company_key AND r.vendor_key = e.vendor_key)"""
register("jn_vendor_lookup", jn_vendor_lookup, LOOKUP + " SELECT company_key, id, status, accounts FROM seen")


def jn_phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, entries = V.book(spark, sf_dir, ("narration", "debit_account"))
    found = H.lookup(entries.withColumn("phrase", X.phrase_key(F.col("narration"))), H.phrase_index(history).drop("raw"), ["phrase"])
    return found.select("company_key", "id", "status", F.array_join("accounts", ",").alias("accounts"))


register("jn_phrase_lookup", jn_phrase_lookup, PHRASES + r"""
, c AS (SELECT company_key, phrase, debit_account AS account, count(*) AS times FROM p GROUP BY ALL), k AS (SELECT company_key, phrase, string_agg(account, ',' ORDER BY times DESC, account) AS accounts, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(lower(narration), '[0-9]+', ' ', 'g'), '[^a-z_\s&]', ' ', 'g')), '\s+', '_', 'g') AS phrase FROM entries)
SELECT e.company_key, id, CASE WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN 'match' ELSE 'conflicted' END AS status, coalesce(accounts, '') AS accounts FROM e LEFT JOIN k ON k.company_key = e.company_key AND k.phrase = e.phrase""")


def jn_supplier_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a company's written names that share a stem: blocking by stem, then the verdict."""
    n = V.vouchers(spark, sf_dir).select("company_key", F.regexp_replace("party", r" Brand#\d+", "").alias("party")).distinct()
    n = n.unionByName(n.select("company_key", F.regexp_replace("party", r"( Ltd| Limited| Pvt Ltd| & Co)$", " LLP").alias("party"))).distinct()
    s = X.supplier_name(F.col("party"))
    n = n.select("company_key", "party", s["stem"].alias("stem"), s["form"].alias("form"))
    b = n.select("company_key", "stem", F.col("party").alias("other"), F.col("form").alias("other_form"))
    pairs = n.join(b, ["company_key", "stem"]).filter(F.col("party") < F.col("other"))
    return pairs.select("company_key", "party", "other", X.same_supplier(F.col("stem"), F.col("form"), F.col("stem"), F.col("other_form")).alias("verdict"))


register("jn_supplier_compare", jn_supplier_compare, r"""
WITH s AS (SELECT DISTINCT n_name AS company_key, s_suppkey, (CASE WHEN s_suppkey % 3 = 0 THEN 'M/s ' ELSE '' END) || s_name AS base, s_suppkey % 5 AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT company_key, s_suppkey, base || (['', ' Ltd', ' Limited', ' Pvt Ltd', ' & Co'])[f + 1] AS party, (['', 'ltd', 'ltd', 'pvt_ltd', 'and_co'])[f + 1] AS form FROM s
      UNION SELECT company_key, s_suppkey, base || CASE WHEN f = 0 THEN '' ELSE ' LLP' END, CASE WHEN f = 0 THEN '' ELSE 'llp' END FROM s)
SELECT a.company_key, a.party, b.party AS other, CASE WHEN a.form = b.form THEN 'same' WHEN a.form IN ('ltd', 'pvt_ltd', 'llp') AND b.form IN ('ltd', 'pvt_ltd', 'llp') THEN 'different' ELSE 'ambiguous' END AS verdict
FROM n a JOIN n b ON a.company_key = b.company_key AND a.s_suppkey = b.s_suppkey AND a.party < b.party""")


def agg_bootstrap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = V.Book(spark, sf_dir, ("vendor", "party", "debit_account", "credit_account"))
    return H.bootstrap_report(book.history, book.chart)


register("agg_bootstrap_report", agg_bootstrap_report, INDEX + """
, v AS (SELECT company_key, count(*) AS vouchers FROM history GROUP BY 1), a AS (SELECT company_key, count(*) AS accounts FROM chart GROUP BY 1),
n AS (SELECT company_key, vendor_key, count(*) AS k FROM pairs GROUP BY ALL), i AS (SELECT company_key, count(*) AS vendors, sum(k)::BIGINT AS mappings, count(*) FILTER (k > 1) AS conflicts FROM n GROUP BY 1)
SELECT company_key, coalesce(vouchers, 0) AS vouchers, coalesce(vendors, 0) AS vendors, coalesce(accounts, 0) AS accounts, coalesce(mappings, 0) AS mappings, coalesce(conflicts, 0) AS conflicts, 0::BIGINT AS unusable,
  CASE WHEN coalesce(vouchers, 0) = 0 THEN 'EMPTY_SOURCE' WHEN coalesce(vendors, 0) = 0 THEN 'EMPTY_VENDOR_INDEX' ELSE 'READY' END AS readiness
FROM a FULL JOIN v USING (company_key) LEFT JOIN i USING (company_key)""")


def agg_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.funding(V.book(spark, sf_dir, ("party", "credit_account"))[0])


register("agg_funding", agg_funding, HISTORY + " SELECT company_key, vendor_key, CASE WHEN count(DISTINCT credit_account) = 1 THEN min(credit_account) END AS funding FROM keyed WHERE vendor_key <> '' GROUP BY ALL")


def agg_trial_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trial_balance(V.vouchers(spark, sf_dir))


TRIAL = ", moves AS (SELECT company_key, seq, total, debit_account AS account, amount_paise AS p FROM numbered UNION ALL SELECT company_key, seq, total, credit_account, -amount_paise FROM numbered)"
register("agg_trial_balance", agg_trial_balance, V.VIEWS + TRIAL + " SELECT company_key, account, sum(p)::BIGINT AS balance FROM moves GROUP BY ALL HAVING sum(p) <> 0")


def jn_balance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, entries = V.book(spark, sf_dir, ("debit_account", "credit_account", "amount_paise"))
    return H.balance_difference(H.trial_balance(history), H.trial_balance(history.unionByName(entries)))


register("jn_balance_diff", jn_balance_diff, V.VIEWS + TRIAL + " SELECT company_key, account, sum(p)::BIGINT AS moved FROM moves WHERE seq > total // 2 GROUP BY ALL HAVING sum(p) <> 0")


def jn_stale_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, entries = V.book(spark, sf_dir, ("vendor", "party", "debit_account"))
    found = H.stale_memory(H.vendor_index(history), history.unionByName(entries))
    return found.select("company_key", "vendor_key", "remembered", F.array_join("live", ",").alias("live"))


register("jn_stale_memory", jn_stale_memory, LOOKUP + """
, every AS (SELECT company_key, vendor_key, debit_account FROM keyed UNION ALL SELECT company_key, vendor_key, debit_account FROM ek),
live AS (SELECT company_key, vendor_key, string_agg(DISTINCT debit_account, ',' ORDER BY debit_account) AS live FROM every GROUP BY ALL)
SELECT company_key, vendor_key, usual AS remembered, live FROM ranked JOIN live USING (company_key, vendor_key) WHERE n = 1 AND live <> usual""")


def flt_day_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.in_range(V.vouchers(spark, sf_dir), "1996-01-01", "1996-03-31").select("company_key", "id", F.col("date").cast("string").alias("date"), "amount_paise")


register("flt_day_book", flt_day_book, V.VIEWS + "SELECT company_key, id, CAST(date AS VARCHAR) AS date, amount_paise FROM vouchers WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")


def flt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.ledger(V.vouchers(spark, sf_dir), "Purchases 3", "1995-01-01", "1997-12-31")
    return rows.groupBy("company_key").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total"))


register("flt_ledger", flt_ledger, V.VIEWS + "SELECT company_key, count(*) AS n, sum(amount_paise)::BIGINT AS total FROM vouchers WHERE debit_account = 'Purchases 3' AND date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY 1")


def flt_ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    tagged = F.when(F.col("amount_paise") % 5 == 0, X.stamped(F.col("narration"), F.concat(F.lit("op-"), "id"))).otherwise(F.col("narration"))
    return H.ours(v.withColumn("narration", tagged)).select("company_key", "id", "operation_id")


register("flt_ours", flt_ours, V.VIEWS + "SELECT company_key, id, 'op-' || id AS operation_id FROM vouchers WHERE amount_paise % 5 = 0")


def win_half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.halves(V.vouchers(spark, sf_dir)).select("company_key", "id", "seq", "role")


register("win_half_split", win_half_split, V.VIEWS + "SELECT company_key, id, seq, CASE WHEN seq <= total // 2 THEN 'history' ELSE 'entry' END AS role FROM numbered")

FLAGS = LOOKUP + """
, days AS (SELECT company_key, debit_account, date, max(amount_paise) AS high, count(*) AS n FROM history GROUP BY ALL),
mag AS (SELECT e.company_key, e.id, e.debit_account, e.amount_paise, sum(d.n) AS seen, max(d.high) AS high FROM entries e JOIN days d ON d.company_key = e.company_key AND d.debit_account = e.debit_account AND d.date < e.date GROUP BY ALL),
tax AS (SELECT company_key, debit_account, count(*) AS n, max(coalesce(gst_paise, 0)) AS most FROM history GROUP BY ALL),
flag_vendor_switch AS (SELECT company_key, id, 'vendor_switch' AS detector, 3 AS severity, party || ' posted to ' || usual || ' ' || most || ' times; this one goes to ' || debit_account AS reason FROM seen WHERE status = 'match' AND most >= 2 AND usual <> debit_account),
  flag_first_use AS (SELECT company_key, id, 'first_use' AS detector, 2 AS severity, debit_account || ' has never been used in this company' AS reason FROM entries e LEFT JOIN (SELECT DISTINCT company_key AS ck, debit_account AS da FROM history) h ON h.ck = e.company_key AND h.da = e.debit_account WHERE h.ck IS NULL),
  flag_magnitude AS (SELECT company_key, id, 'magnitude' AS detector, 2 AS severity, amount_paise || ' paise to ' || debit_account || '; of ' || seen || ' earlier entries the largest is ' || high AS reason FROM mag WHERE seen >= 2 AND amount_paise * 100 > high * 300),
  flag_gst_anomaly AS (SELECT e.company_key, e.id, 'gst_anomaly' AS detector, 3 AS severity, 'tax of ' || e.gst_paise || ' paise on ' || e.debit_account || ', which never carried any across ' || t.n || ' entries' AS reason FROM entries e JOIN tax t ON t.company_key = e.company_key AND t.debit_account = e.debit_account WHERE e.gst_paise <> 0 AND t.most = 0),
raw_flags AS (SELECT * FROM flag_vendor_switch UNION ALL SELECT * FROM flag_first_use UNION ALL SELECT * FROM flag_magnitude UNION ALL SELECT * FROM flag_gst_anomaly)"""
#: Columns that each detector looks at.
_LOOKED_AT = {"vendor_switch": ("vendor", "party", "debit_account"), "first_use": ("debit_account", "gst_paise"), "magnitude": ("debit_account", "amount_paise"), "gst_anomaly": ("debit_account", "gst_paise")}
for _name in T.DETECTORS:
    def _one(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        history, entries = V.book(spark, sf_dir, _LOOKED_AT[name])
        return T.DETECTORS[name](entries, history)

    register(f"win_{_name}", _one, FLAGS + f" SELECT * FROM flag_{_name}")


def win_rank_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, entries = V.book(spark, sf_dir, ("vendor", "party", "debit_account", "amount_paise", "gst_paise"))
    return T.ranked(T.run(entries, history, tuple(T.DETECTORS)), cap=1)


RANKED = FLAGS + """
, con AS (SELECT *, CASE WHEN detector IN ('vendor_switch', 'first_use') THEN 'which account this entry was posted to' WHEN detector = 'magnitude' THEN 'how large this entry is' ELSE 'the tax on this entry' END AS concern FROM raw_flags),
lead AS (SELECT company_key, id, concern, first(detector ORDER BY severity DESC, detector) AS detector, max(severity) AS severity, string_agg(reason, '; also ' ORDER BY severity DESC, detector) AS reason, count(*) - 1 AS duplicates FROM con GROUP BY ALL),
shown AS (SELECT *, row_number() OVER (PARTITION BY company_key, id ORDER BY severity DESC, detector) AS place, greatest(count(*) OVER (PARTITION BY company_key, id) - 1, 0) AS dropped FROM lead)"""
register("win_rank_flags", win_rank_flags, RANKED + " SELECT *, place <= 1 AS shown FROM shown")
register("top_cap", lambda s, d: win_rank_flags(s, d).groupBy("company_key").agg(F.count_if("shown").alias("shown"), F.count_if(~F.col("shown")).alias("dropped")), RANKED + " SELECT company_key, count(*) FILTER (place <= 1) AS shown, count(*) FILTER (place > 1) AS dropped FROM shown GROUP BY 1")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with look-up, flags, checks and problems: one pass over the entries, each table of history joined once."""
    book = V.Book(spark, sf_dir, ("vendor", "party", "debit_account", "credit_account", "amount_paise", "gst_paise"))
    names = tuple(n for n in T.BUILT_IN if n not in T.WITHDRAWN)
    rows = T.flagged(T.with_facts(_looked_up(book), book.history, names), names)
    return D.with_problems(C.checked(rows, book.chart))


PROBLEMS = FLAGS + """
, con AS (SELECT *, CASE WHEN detector = 'vendor_switch' THEN 'account' WHEN detector = 'magnitude' THEN 'size' ELSE 'tax' END AS concern FROM raw_flags WHERE detector <> 'first_use'),
k AS (SELECT v.*, EXISTS (SELECT 1 FROM chart c WHERE c.company_key = v.company_key AND c.account = v.debit_account) AND EXISTS (SELECT 1 FROM chart c WHERE c.company_key = v.company_key AND c.account = v.credit_account) AS known FROM entries v),
problems AS (
  SELECT company_key, id, 'amount_is_positive' AS problem, 1 AS at_place, true AS answerable FROM k WHERE amount_paise <= 0
  UNION ALL SELECT company_key, id, 'accounts_exist', 4, true FROM k WHERE NOT known
  UNION ALL SELECT company_key, id, 'gst_not_larger_than_amount', 6, true FROM k WHERE coalesce(gst_paise, 0) > amount_paise
  UNION ALL SELECT company_key, id, 'tax_lines_can_be_posted', 7, false FROM k WHERE gst_paise IS NOT NULL
  UNION ALL SELECT company_key, id, detector, 1000 + row_number() OVER (PARTITION BY company_key, id ORDER BY severity DESC, detector), true FROM con
  UNION ALL SELECT company_key, id, 'which_account', 5000, true FROM seen WHERE status <> 'match')"""


def dec_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.listed(_decided(spark, sf_dir)).select("company_key", "id", "problem", "answerable")


register("dec_problems", dec_problems, PROBLEMS + " SELECT company_key, id, problem, answerable FROM problems")


def dec_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.outcomes(_decided(spark, sf_dir))


register("dec_outcome", dec_outcome, PROBLEMS + """
, g AS (SELECT company_key, id, bool_or(NOT answerable) AS hopeless, arg_min(problem, at_place) AS head, count(*) AS n FROM problems GROUP BY ALL)
SELECT e.company_key, e.id, CASE WHEN hopeless THEN 'NOT_VALID' WHEN n IS NULL THEN 'VALID' ELSE 'UNCLEAR' END AS outcome, CASE WHEN NOT hopeless THEN head END AS first, coalesce(n, 0) AS n
FROM entries e LEFT JOIN g ON g.company_key = e.company_key AND g.id = e.id""")


def dec_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debit account that memory names alone, the credit account that all postings agree on, and where each comes from."""
    book = V.Book(spark, sf_dir, ("vendor", "party", "debit_account", "credit_account"))
    rows = _looked_up(book).join(H.funding(book.history), ["company_key", "vendor_key"], "left")
    debit = F.when(F.col("status") == "match", F.get("accounts", F.lit(0)))
    return rows.select("company_key", "id", debit.alias("debit"), F.col("funding").alias("credit"), F.when(debit.isNotNull(), "memory").otherwise("not found").alias("debit_source"), F.when(F.col("funding").isNotNull(), "history").otherwise("not found").alias("credit_source"))


register("dec_propose", dec_propose, LOOKUP + """
, fund AS (SELECT company_key, vendor_key, CASE WHEN count(DISTINCT credit_account) = 1 THEN min(credit_account) END AS credit FROM keyed GROUP BY ALL)
SELECT s.company_key, id, CASE WHEN status = 'match' THEN usual END AS debit, credit, CASE WHEN status = 'match' THEN 'memory' ELSE 'not found' END AS debit_source, CASE WHEN credit IS NOT NULL THEN 'history' ELSE 'not found' END AS credit_source
FROM seen s LEFT JOIN fund f ON f.company_key = s.company_key AND f.vendor_key = s.vendor_key""")


def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = H.ranked(H.vendor_index(V.book(spark, sf_dir, ("party", "debit_account"))[0]), ["vendor_key"])
    return ranked.select("company_key", "vendor_key", F.array_join("accounts", ",").alias("accounts"), F.col("accounts")[0].alias("usual"))


register("top_accounts", top_accounts, INDEX + " SELECT company_key, vendor_key, string_agg(account, ',' ORDER BY times DESC, account) AS accounts, first(account ORDER BY times DESC, account) AS usual FROM pairs GROUP BY ALL")


def set_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = V.Book(spark, sf_dir, ("debit_account", "credit_account"))
    return book.chart.join(book.history.select("company_key", F.col("debit_account").alias("account")), ["company_key", "account"], "left_anti")


register("set_unmapped", set_unmapped, V.VIEWS + "SELECT company_key, account FROM chart c WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.company_key = c.company_key AND h.debit_account = c.account)")


def set_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir)
    named = v.select("company_key", F.col("debit_account").alias("account"))
    return named.unionByName(v.select("company_key", F.lit("not in source").alias("account"))).distinct()


register("set_chart", set_chart, V.VIEWS + "SELECT company_key, debit_account AS account FROM vouchers UNION SELECT company_key, 'not in source' FROM vouchers")


def jn_key_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    names = c.select(F.concat(F.lit("Co. "), (F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 4 == 0, "!").when(F.col("c_custkey") % 4 == 1, " ").otherwise("")).alias("company"))
    return H.key_collisions(names).select("key", F.array_join("names", "|").alias("names"))


register("jn_key_collision", jn_key_collision, r"""
WITH n AS (SELECT DISTINCT 'Co. ' || (c_custkey % 50) || CASE c_custkey % 4 WHEN 0 THEN '!' WHEN 1 THEN ' ' ELSE '' END AS company FROM customer),
k AS (SELECT company, regexp_replace(trim(regexp_replace(lower(company), '[^a-z0-9_\s]', ' ', 'g')), '\s+', '_', 'g') AS key FROM n)
SELECT key, string_agg(company, '|' ORDER BY company) AS names FROM k GROUP BY key HAVING count(*) > 1""")
