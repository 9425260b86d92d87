"""Queries on reversals and proposals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as X
from ..operators import audit as A
from ..operators import reversal as R
from ..shared import folder
from ..streaming import proposals as P
from . import views as V


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("amount_paise")
    return V.vouchers(spark, sf_dir).select("company_key", F.concat(F.lit("op-"), "id").alias("operation_id"), F.when(a % 5 == 0, "UNKNOWN").when(a % 5 == 1, "FAILED").when(a % 5 == 2, "NOT_ATTEMPTED").otherwise("REVERSED").alias("state"))


_OUT = V.VIEWS + ", o AS (SELECT company_key, 'op-' || id AS operation_id, amount_paise AS a, CASE amount_paise % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'NOT_ATTEMPTED' ELSE 'REVERSED' END AS state FROM vouchers)"
register("flt_reversal", lambda s, d: R.in_state(_outcomes(s, d), R.UNRESOLVED), _OUT + " SELECT company_key, operation_id, state FROM o WHERE state IN ('UNKNOWN', 'NOT_ATTEMPTED', 'FAILED')")


def jn_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vouchers(spark, sf_dir).filter("amount_paise % 3 = 0")
    found = R.candidates(v.withColumn("narration", X.stamped(F.col("narration"), F.concat(F.lit("op-"), "id"))))
    return R.reconciled(_outcomes(spark, sf_dir), found, F.col("company_key") != "NATION_3")


register("jn_reconcile", jn_reconcile, _OUT + " SELECT company_key, operation_id, CASE WHEN a % 3 = 0 THEN 'NOT_ATTEMPTED' ELSE 'REVERSED_VERIFIED' END AS state FROM o WHERE state = 'UNKNOWN' AND company_key <> 'NATION_3'")
register("flt_rev_events", lambda s, d: V.action_log(s, d).filter(F.col("action").isin("reversed", "write_outcome_unknown")).select("seq", "company_key", "action"), V.VIEWS + "SELECT seq, company_key, action FROM action_log WHERE action IN ('reversed', 'write_outcome_unknown')")


def agg_history_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.action_log(spark, sf_dir)
    return R.completeness(log.withColumn("actor", F.when(F.col("seq") % 7 != 0, F.lit("me"))).withColumn("reason", F.when(F.col("seq") % 11 == 0, F.lit("  ")).otherwise(F.lit("asked"))))


register("agg_history_audit", agg_history_audit, V.VIEWS + """
, g AS (SELECT count(*) AS events, count(*) FILTER (seq % 7 <> 0 AND seq % 11 <> 0) AS complete, count(*) FILTER (seq % 7 = 0) AS a, count(*) FILTER (seq % 11 = 0) AS r FROM action_log)
SELECT field, CASE field WHEN 'actor' THEN a WHEN 'reason' THEN r ELSE 0 END::BIGINT AS missing, events, complete FROM g, (VALUES ('company_key'), ('operation_id'), ('action'), ('outcome'), ('actor'), ('reason'), ('ts')) f(field)""")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as moves of proposals: every user's events in turn, now and then out of order, without a reason or without an operation."""
    n = F.col("event_id")
    nth = F.when(F.col("event_type") == "view", F.when(n % 3 == 0, "conservation_failed").otherwise("conservation_passed")).when(F.col("event_type") == "click", F.when(n % 5 == 0, "validation_failed").otherwise("validation_passed"))
    nth = nth.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, ("confidence_high", "confidence_medium", "confidence_low", "answered", "answers_exhausted"))), (n % 5 + 1).cast("int")))
    nth = nth.when(F.col("event_type") == "purchase", F.element_at(F.array(*map(F.lit, ("write_claimed", "write_confirmed", "write_failed"))), (n % 3 + 1).cast("int"))).otherwise(F.when(n % 2 == 0, "hard_rule_violated").otherwise("confidence_high"))
    e = V.table(spark, sf_dir, "events")
    return e.select(F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("proposal"), n.alias("seq"), nth.alias("event"), F.when(n % 7 != 0, "said").alias("reason"), F.when(n % 4 != 0, "op").alias("operation_id"), F.when(n % 2 == 0, "me").alias("actor"))


def _followed(spark: SparkSession, sf_dir: str) -> str:
    """The events as a stream, in order of their numbers, a third at a time, through the state machine, which starts anew for each; where its moves are."""
    place, rows = folder(spark), _proposals(spark, sf_dir)
    most = rows.agg(F.max("seq").alias("m")).first()["m"] or 0
    for k in range(3):
        rows.filter(F.expr(f"seq * 3 div {most + 1}") == k).write.mode("append").parquet(f"{place}/in")
        P.follow(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return f"{place}/out"


_STATES = """
WITH RECURSIVE e AS (SELECT user_id || '-' || (props ->> 'k') AS p, event_id AS q, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'conservation_failed' ELSE 'conservation_passed' END WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'validation_failed' ELSE 'validation_passed' END
    WHEN 'error' THEN (['confidence_high', 'confidence_medium', 'confidence_low', 'answered', 'answers_exhausted'])[event_id % 5 + 1] WHEN 'purchase' THEN (['write_claimed', 'write_confirmed', 'write_failed'])[event_id % 3 + 1] ELSE CASE WHEN event_id % 2 = 0 THEN 'hard_rule_violated' ELSE 'confidence_high' END END AS v,
    event_id % 7 <> 0 AS said, event_id % 4 <> 0 AS op, event_id % 2 = 0 AS me FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY q) AS i, count(*) OVER (PARTITION BY p) AS c FROM e),
f AS (SELECT p, 0::BIGINT AS i, 'observed' AS s, false AS cp, false AS vp, false AS ok, 0::BIGINT AS bad FROM (SELECT DISTINCT p FROM e)
  UNION ALL SELECT p, i, coalesce(t, s), cp OR (t IS NOT NULL AND v = 'conservation_passed'), vp OR (t IS NOT NULL AND v = 'validation_passed'), ok OR (t IS NOT NULL AND v IN ('confidence_high', 'answered')), bad + CASE WHEN t IS NULL THEN 1 ELSE 0 END
  FROM (SELECT f.p, n.i, s, cp, vp, ok, bad, v, CASE
      WHEN v = 'conservation_passed' AND s = 'observed' AND NOT cp THEN CASE WHEN vp THEN 'checked' ELSE 'observed' END WHEN v = 'validation_passed' AND s = 'observed' AND NOT vp THEN CASE WHEN cp THEN 'checked' ELSE 'observed' END
      WHEN v IN ('conservation_failed', 'validation_failed') AND s = 'observed' AND said THEN 'blocked' WHEN v = 'confidence_high' AND s = 'checked' THEN 'decided' WHEN v = 'confidence_medium' AND s = 'checked' THEN 'asking' WHEN v = 'confidence_low' AND s = 'checked' AND said THEN 'blocked'
      WHEN v = 'answered' AND s = 'asking' AND said THEN 'decided' WHEN v = 'answers_exhausted' AND s = 'asking' AND said THEN 'blocked' WHEN v = 'write_claimed' AND s = 'decided' AND op AND (ok OR me) THEN 'posting' WHEN v = 'write_confirmed' AND s = 'posting' AND said THEN 'posted'
      WHEN v = 'write_failed' AND s = 'posting' AND said THEN 'blocked' WHEN v = 'hard_rule_violated' AND s IN ('observed', 'checked', 'decided', 'asking') AND said THEN 'blocked' END AS t FROM f JOIN n ON n.p = f.p AND n.i = f.i + 1))
"""
_LAST = _STATES + " SELECT f.p AS proposal, s AS state, bad AS illegal FROM f JOIN (SELECT DISTINCT p, c FROM n) l ON l.p = f.p AND l.c = f.i"
register("st_state", lambda s, d: P.states(s, _followed(s, d)), _LAST)
register("st_state_fold", lambda s, d: R.folded(_proposals(s, d), ["proposal"]), _LAST)  # the batch form: all events of a proposal, folded at once
register("st_state_refused", lambda s, d: P.told(s, _followed(s, d), True).select("proposal", "seq", "event", "before", "verdict"), _STATES + """
SELECT g.p AS proposal, n.q AS seq, n.v AS event, f.s AS before, 'illegal' AS verdict FROM f JOIN f g ON g.p = f.p AND g.i = f.i + 1 AND g.bad > f.bad JOIN n ON n.p = g.p AND n.i = g.i""")


def jn_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.action_log(spark, sf_dir)
    back = log.filter("seq % 90 <> 4").withColumn("action", F.when(F.col("seq") % 64 == 4, "edited").otherwise(F.col("action")))
    return A.overwritten(log, back, ["seq", "action"]).groupBy("what").agg(F.count("*").alias("n"))


register("jn_overwritten", jn_overwritten, V.VIEWS + """
, w AS (SELECT seq, action FROM action_log), a AS (SELECT *, row_number() OVER (ORDER BY seq) AS p FROM w),
b AS (SELECT seq, CASE WHEN seq % 64 = 4 THEN 'edited' ELSE action END AS action, row_number() OVER (ORDER BY seq) AS p FROM w WHERE seq % 90 <> 4),
j AS (SELECT CASE WHEN b.p IS NULL THEN 'MISSING' WHEN a.p IS NULL THEN 'ADDED' WHEN a.seq <> b.seq OR a.action <> b.action THEN 'CHANGED' END AS what FROM a FULL JOIN b USING (p))
SELECT what, count(*) AS n FROM j WHERE what IS NOT NULL GROUP BY 1""")


def jn_overwritten_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the log, whatever its company, against what is read back."""
    log = V.action_log(spark, sf_dir)
    back = log.filter("seq % 9000 <> 4").withColumn("action", F.when(F.col("seq") % 64 == 4, "edited").otherwise(F.col("action")))
    return A.overwritten(log, back, ["seq", "action"]).groupBy("what").agg(F.count("*").alias("n"))


register("jn_overwritten_all", jn_overwritten_all, V.VIEWS + """
, a AS (SELECT seq, action, row_number() OVER (ORDER BY seq) AS p FROM action_log),
b AS (SELECT seq, CASE WHEN seq % 64 = 4 THEN 'edited' ELSE action END AS action, row_number() OVER (ORDER BY seq) AS p FROM action_log WHERE seq % 9000 <> 4),
j AS (SELECT CASE WHEN b.p IS NULL THEN 'MISSING' WHEN a.p IS NULL THEN 'ADDED' WHEN a.seq <> b.seq OR a.action <> b.action THEN 'CHANGED' END AS what FROM a FULL JOIN b USING (p))
SELECT what, count(*) AS n FROM j WHERE what IS NOT NULL GROUP BY 1""")


def jn_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.action_log(spark, sf_dir).withColumn("tenant_id", F.col("seq") % 25)
    tenants = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("tenant_id"), F.when(F.col("n_regionkey") == 1, F.lit("2024-06-01")).alias("deleted_at"))
    return R.retained(log, tenants).groupBy("company_key").agg(F.count("*").alias("rows"), F.count("deleted_at").alias("marked"))


register("jn_retained", jn_retained, V.VIEWS + "SELECT company_key, count(*) AS rows, count(*) FILTER (n_regionkey = 1) AS marked FROM action_log LEFT JOIN nation ON n_nationkey = seq % 25 GROUP BY 1")


def set_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "total"), F.when(F.col("doc_id") % 3 == 0, "number"), F.when(F.col("doc_id") % 5 == 0, "date"))).alias("fields"))
    return R.unmet(d, ("number", "date", "total", "supplier")).select("doc_id", F.array_join("missing", ",").alias("missing"))


register("set_mandatory", set_mandatory, "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 <> 0 THEN 'number' END, CASE WHEN doc_id % 5 <> 0 THEN 'date' END, CASE WHEN doc_id % 2 <> 0 THEN 'total' END, 'supplier') AS missing FROM documents")
