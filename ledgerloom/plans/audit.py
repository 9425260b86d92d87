"""Queries on tax rules and on the log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import audit as A
from ..operators import ranks as K
from ..operators import tax as X
from . import views as V

#: Fixed rows: overlaps, gaps, ended and unchecked windows. code, type, id, rate, from, to, checked through, url, number, retrieved, authority, status, version.
_RULES = [
    ("2523", "CGST", "r1", 900, "1995-01-01", "1997-12-31", "1999-12-31", "u", "n1", "2020-01-01", "gazette", "active", 1),
    ("2523", "CGST", "r2", 1400, "1998-01-01", None, "1999-12-31", "u", "n2", "2020-01-01", "gazette", "active", 1),
    ("2523", "SGST", "r3", 900, "1995-01-01", None, "2030-12-31", "u", "n3", "2020-01-01", "gazette", "active", 1),
    ("4820", "CGST", "r4", 600, "1996-01-01", "1999-06-30", "2030-12-31", "u", "n4", "2020-01-01", "gazette", "active", 1),
    ("4820", "CGST", "r5", 250, "1999-01-01", "1999-12-31", "2030-12-31", "u", "n5", "2020-01-01", "gazette", "active", 1),
    ("4820", "IGST", "r6", 1200, "1999-01-01", None, "2030-12-31", "u", "n6", "2020-01-01", "gazette", "active", 1),
    ("9972", "IGST", "r7", 1800, "1990-01-01", None, None, "u", "n7", "2020-01-01", "gazette", "active", 1),
    ("9987", "SGST", "r8", 900, "2000-01-01", None, "2030-12-31", "u", "n8", "2020-01-01", "gazette", "active", 1),
    ("9987", "IGST", "b1", 1800, "1990-01-01", None, "2030-12-31", "", "n9", "2020-01-01", "gazette", "active", 1),
    ("9987", "IGST", "b2", 1800, "1990-01-01", None, "2030-12-31", "u", " ", "2020-01-01", "gazette", "active", 1),
    ("9987", "IGST", "b3", 1800, None, None, "2030-12-31", "u", "n", "2020-01-01", "blog", "active", 1),
    ("9987", "IGST", "b4", -5, "1990-01-01", None, "2030-12-31", "u", "n", "2020-01-01", "gazette", "active", 1),
    ("9987", "IGST", "b5", 1800, "1990-01-01", None, "2030-12-31", "u", "n", "2020-01-01", "gazette", "repealed", 1),
]
_COLUMNS = "code string, tax_type string, rule_id string, rate_basis_points long, effective_from string, effective_to string, amendments_checked_through string, source_url string, notification_number string, retrieved_on string, authority string, status string, version int"
_DATES = ("effective_from", "effective_to", "amendments_checked_through", "retrieved_on")
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _RULES)
RULES_SQL = ", all_rules AS (SELECT * REPLACE (CAST(effective_from AS DATE) AS effective_from, CAST(effective_to AS DATE) AS effective_to, CAST(amendments_checked_through AS DATE) AS amendments_checked_through, CAST(retrieved_on AS DATE) AS retrieved_on) FROM (VALUES " + _VALUES + ") v(" + ", ".join(c.split()[0] for c in _COLUMNS.split(", ")) + "))"
GOOD_SQL = RULES_SQL + ", rules AS (SELECT * FROM all_rules WHERE trim(source_url) <> '' AND trim(notification_number) <> '' AND effective_from IS NOT NULL AND authority <> 'blog' AND status = 'active' AND rate_basis_points >= 0)"


def rules(spark: SparkSession) -> DataFrame:
    r = spark.createDataFrame(_RULES, _COLUMNS)
    return r.withColumns({c: F.col(c).cast("date") for c in _DATES})


def good_rules(spark: SparkSession) -> DataFrame:
    return X.load_rules(rules(spark)).filter("why_not IS NULL")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voucher asks for the rate of one code and type on its day."""
    v = V.vouchers(spark, sf_dir)
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    return v.select("id", pick(("2523", "4820", "9972", "9987", "1234"), F.col("amount_paise") % 5).alias("code"), pick(("CGST", "SGST", "IGST", "CESS"), F.expr("amount_paise div 5 % 4")).alias("tax_type"), F.col("date").alias("on"))


def jn_rate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rate_lookup(_asked(spark, sf_dir), good_rules(spark))


RATES = GOOD_SQL + """
, asked AS (SELECT id, (['2523', '4820', '9972', '9987', '1234'])[amount_paise % 5 + 1] AS code, (['CGST', 'SGST', 'IGST', 'CESS'])[amount_paise // 5 % 4 + 1] AS tax_type, date AS day FROM vouchers),
j AS (SELECT a.id, a.tax_type, count(*) FILTER (effective_from <= day AND (effective_to IS NULL OR effective_to >= day)) AS now, count(*) FILTER (effective_to < day) AS ended, count(*) FILTER (effective_from > day) AS later,
  min(rule_id) FILTER (effective_from <= day AND (effective_to IS NULL OR effective_to >= day)) AS one, min(rate_basis_points) FILTER (effective_from <= day AND (effective_to IS NULL OR effective_to >= day)) AS rate,
  bool_or(amendments_checked_through IS NULL OR amendments_checked_through < day) FILTER (effective_from <= day AND (effective_to IS NULL OR effective_to >= day)) AS stale
  FROM asked a LEFT JOIN rules r ON r.code = a.code AND r.tax_type = a.tax_type GROUP BY ALL),
o AS (SELECT *, CASE WHEN tax_type NOT IN (SELECT tax_type FROM rules) THEN 'SOURCE_UNVERIFIED' WHEN now > 1 THEN 'CONFLICT' WHEN now = 1 AND stale THEN 'BEYOND_AMENDMENT_CHECK' WHEN now = 1 THEN 'FOUND' WHEN ended > 0 THEN 'ENDED' WHEN later > 0 THEN 'NOT_YET' ELSE 'NOT_FOUND' END AS outcome FROM j)"""
register("jn_rate_asof", jn_rate_asof, V.VIEWS.rstrip() + RATES + " SELECT id, tax_type, outcome, CASE WHEN outcome = 'FOUND' THEN one END AS rule_id, CASE WHEN outcome = 'FOUND' THEN rate END AS rate FROM o")


def jn_rule_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the vouchers that each one's window covers: kept ones and those set aside, with the reason."""
    per = V.vouchers(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"))
    r = X.load_rules(rules(spark))
    spans = r.filter("effective_from IS NOT NULL").select(F.col("rule_id").alias("id"), F.col("effective_from").alias("low"), F.col("effective_to").alias("high"))
    covers = K.covered(per.select(F.col("date").alias("at"), "n"), spans)
    return r.join(covers, F.col("rule_id") == F.col("id"), "left").select("rule_id", "why_not", F.coalesce("covers", F.lit(0)).alias("covers"))


register("jn_rule_load", jn_rule_load, V.VIEWS.rstrip() + RULES_SQL + """
, w AS (SELECT *, CASE WHEN trim(source_url) = '' THEN 'NO_URL' WHEN trim(notification_number) = '' THEN 'NO_NUMBER' WHEN effective_from IS NULL THEN 'NO_EFFECTIVE_DATE' WHEN authority = 'blog' THEN 'WEAK_AUTHORITY' WHEN status <> 'active' THEN 'NOT_ACTIVE' WHEN rate_basis_points < 0 THEN 'NEGATIVE_RATE' END AS why_not FROM all_rules)
SELECT rule_id, why_not, count(id) AS covers FROM w LEFT JOIN vouchers ON date >= effective_from AND (effective_to IS NULL OR date <= effective_to) GROUP BY ALL""")


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voucher as a supply between two-digit states, with a tax id that is sometimes another state's or unreadable."""
    v = V.vouchers(spark, sf_dir)
    state = lambda c: F.lpad(c.cast("string"), 2, "0")
    a, b = F.col("amount_paise") % 40, F.expr("amount_paise div 40 % 3")
    own = F.when(F.col("amount_paise") % 31 == 0, F.lit(None)).otherwise(state(a))
    shown = F.when(F.col("amount_paise") % 17 == 0, F.lit("unreadable")).when(F.col("amount_paise") % 13 == 0, F.concat(state((a + 1) % 40), F.lit("ABCDE1234F1Z5"))).when(F.col("amount_paise") % 2 == 0, F.concat(state(a), F.lit("ABCDE1234F1Z5")))
    return v.select("id", "date", F.col("amount_paise").alias("taxable"), own.alias("supplier_state"), F.when(F.col("amount_paise") % 29 != 0, state((a + b) % 40)).alias("place_state"), shown.alias("supplier_id"))


def _states(spark: SparkSession) -> DataFrame:
    return spark.range(1, 38).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("state"), F.col("id").isin(4, 26, 31, 35).alias("territory"))


def jn_place_of_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.place_of_supply(_supplies(spark, sf_dir), _states(spark)).select("id", "supply", "second")


SUPPLY = """
, s0 AS (SELECT id, date, amount_paise AS taxable, amount_paise AS p, amount_paise % 40 AS a, amount_paise // 40 % 3 AS b FROM vouchers),
s1 AS (SELECT *, CASE WHEN p % 31 <> 0 THEN lpad(CAST(a AS VARCHAR), 2, '0') END AS own, CASE WHEN p % 29 <> 0 THEN lpad(CAST((a + b) % 40 AS VARCHAR), 2, '0') END AS place,
  CASE WHEN p % 17 = 0 THEN 'unreadable' WHEN p % 13 = 0 THEN lpad(CAST((a + 1) % 40 AS VARCHAR), 2, '0') WHEN p % 2 = 0 THEN lpad(CAST(a AS VARCHAR), 2, '0') END AS told FROM s0),
s2 AS (SELECT *, CASE WHEN own IS NULL THEN 'SUPPLIER_UNKNOWN' WHEN place IS NULL THEN 'PLACE_UNKNOWN' WHEN CAST(own AS INTEGER) NOT BETWEEN 1 AND 37 THEN 'SUPPLIER_NOT_A_STATE' WHEN CAST(place AS INTEGER) NOT BETWEEN 1 AND 37 THEN 'PLACE_NOT_A_STATE'
  WHEN told = 'unreadable' THEN 'ID_UNREADABLE' WHEN told <> own THEN 'ID_CONTRADICTS' WHEN own = place THEN 'INTRA' ELSE 'INTER' END AS supply FROM s1),
supplies AS (SELECT *, CASE WHEN supply = 'INTRA' THEN CASE WHEN CAST(place AS INTEGER) IN (4, 26, 31, 35) THEN 'UTGST' ELSE 'SGST' END END AS second FROM s2)"""
register("jn_place_of_supply", jn_place_of_supply, V.VIEWS.rstrip() + SUPPLY + " SELECT id, supply, second FROM supplies")


def agg_tax_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.place_of_supply(_supplies(spark, sf_dir), _states(spark))
    code = F.when(F.col("taxable") % 2 == 0, "2523").otherwise("4820")
    return X.compute(s.select("id", (F.expr("taxable div 1000") * 1000).alias("taxable"), "supply", "second", code.alias("code"), F.col("date").alias("on")), good_rules(spark))


register("agg_tax_compute", agg_tax_compute, V.VIEWS.rstrip() + GOOD_SQL + SUPPLY + """
, lines AS (SELECT id, supply, taxable // 1000 * 1000 AS taxable, CASE WHEN p % 2 = 0 THEN '2523' ELSE '4820' END AS code, date AS day, unnest(CASE supply WHEN 'INTRA' THEN ['CGST', second] WHEN 'INTER' THEN ['IGST'] ELSE [NULL] END) AS tax_type FROM supplies),
f AS (SELECT l.id, l.tax_type, any_value(supply) AS supply, any_value(taxable) AS taxable, count(r.rule_id) AS now, min(rate_basis_points) AS rate, bool_or(amendments_checked_through IS NULL OR amendments_checked_through < day) AS stale
  FROM lines l LEFT JOIN rules r ON r.code = l.code AND r.tax_type = l.tax_type AND effective_from <= day AND (effective_to IS NULL OR effective_to >= day) GROUP BY ALL),
x AS (SELECT *, CASE WHEN now = 1 AND NOT stale AND taxable * rate % 10000 = 0 THEN taxable * rate // 10000 END AS tax FROM f),
g AS (SELECT id, any_value(supply) AS supply, any_value(taxable) AS taxable, count(tax_type) AS n, count(tax) AS known, sum(tax)::BIGINT AS tax FROM x GROUP BY id),
o AS (SELECT *, CASE WHEN supply IN ('ID_CONTRADICTS', 'ID_UNREADABLE') OR taxable <= 0 THEN 'NOT_VALID' WHEN n = 0 OR known < n THEN 'UNCLEAR' ELSE 'VALID' END AS outcome FROM g)
SELECT id, outcome, CASE WHEN outcome = 'VALID' THEN tax END AS tax FROM o""")


def jn_ledger_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.Book(spark, sf_dir, ("debit_account", "credit_account", "gst_paise"))
    lines = own.rows.filter("gst_paise IS NOT NULL").select("company_key", "id", F.explode(F.array(F.lit("CGST"), F.lit("SGST"))).alias("tax_type"))
    names = spark.createDataFrame([("CGST", "1-URGENT"), ("SGST", "Purchases 3")], "tax_type string, ledger string")
    return X.ledger_map(lines, names, own.chart).select("company_key", "id", "outcome", F.array_join("missing", ",").alias("missing"))


register("jn_ledger_map", jn_ledger_map, V.VIEWS + """
, l AS (SELECT company_key, id, unnest(['1-URGENT', 'Purchases 3']) AS ledger FROM vouchers WHERE gst_paise IS NOT NULL),
j AS (SELECT l.*, c.account IS NOT NULL AS known FROM l LEFT JOIN chart c ON c.company_key = l.company_key AND c.account = l.ledger)
SELECT company_key, id, CASE WHEN bool_and(known) THEN 'MAPPED' ELSE 'LEDGER_MISSING' END AS outcome, coalesce(string_agg(DISTINCT ledger, ',' ORDER BY ledger) FILTER (NOT known), '') AS missing FROM j GROUP BY company_key, id""")


def jn_period_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 5")
    start = F.make_date(1994 + F.col("n_nationkey") % 5, F.lit(4), F.lit(1))
    periods = n.select(F.col("n_name").alias("company_key"), start.alias("starts"), F.when(F.col("n_nationkey") % 2 == 0, F.add_months(start, 30)).alias("ends"))
    return X.period_open(V.vouchers(spark, sf_dir), periods).select("id", "period")


register("jn_period_open", jn_period_open, V.VIEWS + """
, p AS (SELECT n_name AS ck, n_nationkey % 2 AS odd, make_date(1994 + n_nationkey % 5, 4, 1) AS starts FROM nation WHERE n_nationkey % 6 <> 5)
SELECT id, CASE WHEN starts IS NULL THEN 'UNVERIFIED' WHEN date BETWEEN starts AND CASE WHEN odd = 0 THEN (starts + INTERVAL 30 MONTH)::DATE ELSE (starts + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE END THEN 'OPEN' ELSE 'CLOSED' END AS period
FROM vouchers LEFT JOIN p ON ck = company_key""")

def agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, with replays that were refused and reversals by batch."""
    log = V.action_log(spark, sf_dir)
    log = log.withColumn("action", F.when((F.col("action") == "write_attempted") & (F.col("seq") % 10 == 0), "replay_refused").otherwise(F.col("action"))).withColumn("batch_id", F.when(F.col("seq") % 3 == 0, F.lit("b")))
    return A.metrics(log)


register("agg_metrics", agg_metrics, V.VIEWS + """
, l AS (SELECT * REPLACE (CASE WHEN action = 'write_attempted' AND seq % 10 = 0 THEN 'replay_refused' ELSE action END AS action) FROM action_log),
g AS (SELECT company_key, count(*) AS rows, count(DISTINCT operation_id) FILTER (action = 'decided') AS entries, count(DISTINCT operation_id) FILTER (action = 'decided' AND outcome = 'unclear') AS asked,
  count(*) FILTER (outcome = 'valid') AS valid, count(*) FILTER (outcome = 'unclear') AS unclear, count(*) FILTER (outcome = 'not_valid') AS not_valid, count(*) FILTER (outcome = 'unknown') AS unknown,
  count(*) FILTER (action = 'write_attempted') AS writes, count(*) FILTER (action = 'write_outcome_unknown') AS writes_unknown, count(*) FILTER (action = 'reversed' AND seq % 3 <> 0) AS reversals_single, count(*) FILTER (action = 'reversed' AND seq % 3 = 0) AS reversals_bulk, count(*) FILTER (action = 'replay_refused') AS replays_refused FROM l GROUP BY 1)
SELECT * EXCLUDE (asked), CASE WHEN entries > 0 THEN round(asked / entries, 3) END AS question_rate FROM g""")
register("agg_claims", lambda s, d: A.claims(V.action_log(s, d)), V.VIEWS + "SELECT company_key, operation_id, min(seq) AS seq, count(*) - 1 AS refused FROM action_log GROUP BY ALL")
register("win_chain", lambda s, d: A.chain(V.action_log(s, d), ["company_key", "operation_id"], "action", "none").select("seq", "previous", "last"), V.VIEWS + """
SELECT seq, lag(action, 1, 'none') OVER w AS previous, lead(seq) OVER w IS NULL AS last FROM action_log WINDOW w AS (PARTITION BY company_key, operation_id ORDER BY seq)""")


def jn_history_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of operations: what each event states of the one before, against what is recorded and expected."""
    log = V.action_log(spark, sf_dir)
    events = log.select("operation_id", "seq", F.col("action").alias("state"), F.when(F.col("seq") % 50 == 0, "elsewhere").otherwise(F.lag("action", 1, "none").over(A.W.partitionBy("operation_id").orderBy("seq"))).alias("stated"))
    known = log.select("operation_id").distinct().filter("operation_id NOT LIKE '3-%'")
    absent = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("absent-"), "n_name").alias("operation_id"))
    return A.gaps(events, known.unionByName(absent).select("operation_id", F.lit("none").alias("start"), F.lit("posted").alias("end")), ["operation_id"])


register("jn_history_gaps", jn_history_gaps, V.VIEWS + """
, e AS (SELECT operation_id, seq, action, lag(action) OVER (PARTITION BY operation_id ORDER BY seq) AS before FROM action_log),
t AS (SELECT *, CASE WHEN seq % 50 = 0 THEN 'elsewhere' ELSE coalesce(before, 'none') END AS stated FROM e),
g AS (SELECT operation_id, arg_min(stated, seq) AS first, arg_max(action, seq) AS fin, count(*) FILTER (before IS NOT NULL AND before <> stated) AS broken FROM t GROUP BY 1),
x AS (SELECT DISTINCT operation_id FROM action_log WHERE operation_id NOT LIKE '3-%' UNION ALL SELECT 'absent-' || n_name FROM nation),
o AS (SELECT operation_id, CASE WHEN x.operation_id IS NULL THEN 'UNKNOWN_SCOPE' WHEN g.operation_id IS NULL THEN 'MISSING' WHEN first <> 'none' THEN 'FOREIGN_START' WHEN broken > 0 THEN 'BROKEN' WHEN fin <> 'posted' THEN 'WRONG_END' END AS why FROM g FULL JOIN x USING (operation_id))
SELECT * FROM o WHERE why IS NOT NULL""")


def jn_deletion_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    log = e.select((F.col("user_id") % 7).cast("string").alias("tenant_id"), (F.col("user_id") % 7 + F.col("event_id") % 3).cast("string").alias("company_key"))
    return A.deletion_scope(log, "0")


register("jn_deletion_scope", jn_deletion_scope, """
WITH p AS (SELECT DISTINCT user_id % 7 AS t, CAST(user_id % 7 + event_id % 3 AS VARCHAR) AS company_key FROM events)
SELECT company_key, CASE WHEN EXISTS (SELECT 1 FROM p o WHERE o.t <> 0 AND o.company_key = p.company_key) THEN 'KEEP' ELSE 'ERASE' END AS verdict FROM p WHERE t = 0""")


def agg_op_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return A.operations(e.select(F.col("event_type").alias("operation"), (F.col("value") >= 5).alias("ok"), F.round(F.col("value") * 100).cast("bigint").alias("ms")))


register("agg_op_summary", agg_op_summary, """
WITH g AS (SELECT event_type AS operation, count(*) AS n, count(*) FILTER (value < 5) AS failures, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS ms FROM events GROUP BY 1)
SELECT operation, n, failures, (2 * 10000 * (n - failures) + n) // (2 * n) AS success_rate, ms // n AS mean_ms FROM g""")
register("agg_percentile", lambda s, d: K.percentiles(V.table(s, d, "events"), "event_type", "value", (50, 95)), """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = greatest(1, (50 * n + 99) // 100)) AS p50, max(value) FILTER (k = greatest(1, (95 * n + 99) // 100)) AS p95 FROM r GROUP BY 1""")
register("top_recent", lambda s, d: V.action_log(s, d).orderBy(F.desc("seq")).limit(50).select("seq", "company_key", "action"), V.VIEWS + "SELECT seq, company_key, action FROM action_log ORDER BY seq DESC LIMIT 50")
