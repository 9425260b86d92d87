"""Queries that measure the detectors, with their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import detect as T
from ..operators import evaluate as E
from ..operators import history as H
from . import views as V
from .ledger import FLAGS, LOOKUP

#: One entry in twenty of a company (rounded down) is corrupted; seconds that a person takes to read an entry, and to dismiss a flag.
RATE, SEED, READ, DISMISS = Fraction(1, 20), 7, 30, 20
ACTIVE = tuple(n for n in T.BUILT_IN if n not in T.WITHDRAWN)


COLUMNS = ("vendor", "party", "debit_account", "credit_account", "amount_paise", "gst_paise")


def _scored(spark: SparkSession, sf_dir: str, detectors: tuple[str, ...] = ACTIVE) -> DataFrame:
    """Corrupted entries with error_type, ``detectors`` (those that fire) and flagged: the book is read once, each table of history joined once."""
    return scored(V.Book(spark, sf_dir, COLUMNS), detectors)


def scored(book: V.Book, detectors: tuple[str, ...], **more: Column) -> DataFrame:
    """The same of a given book with ``COLUMNS``, and with more columns of an entry before it is corrupted."""
    entries = book.entries.withColumns(more).drop("seq", "party")  # no reasons are told, and the vendor is taken apart
    rows = E.injected(entries, RATE, SEED, exact=False)
    return T.detected(T.with_facts(rows, book.history, detectors), detectors)


#: The entries are corrupted first, and all that FLAGS derives follows from them.
_CORRUPT = r"""
, cn AS (SELECT *, regexp_replace(trim(regexp_replace(lower(party), '[^\p{L}\p{N}]+', ' ', 'g')), '^m s ', '') AS vk, md5('7|' || id) AS h FROM clean_entries),
va AS (SELECT company_key, regexp_replace(vk, ' (pvt ltd|ltd|limited|co)$', '') || CASE WHEN regexp_matches(vk, ' pvt ltd$') THEN '|p' WHEN regexp_matches(vk, ' (ltd|limited)$') THEN '|l' WHEN regexp_matches(vk, ' co$') THEN '|c' ELSE '' END AS vendor, min(debit_account) AS low, max(debit_account) AS top FROM cn GROUP BY ALL),
ac AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY debit_account) - 1 AS place, count(*) OVER (PARTITION BY company_key) AS many
       FROM (SELECT company_key, debit_account, max(amount_paise) AS high, bool_or(coalesce(gst_paise, 0) <> 0) AS taxed FROM clean_entries GROUP BY ALL)),
ct AS (SELECT cn.*, CASE WHEN va.low = va.top THEN va.low END AS single, a.high, a.taxed, a.place, b.place AS other, a.many,
         a.many - 1 - CASE WHEN b.place IS NOT NULL AND b.place <> a.place THEN 1 ELSE 0 END AS targets
       FROM cn JOIN va ON va.company_key = cn.company_key AND va.vendor = regexp_replace(vk, ' (pvt ltd|ltd|limited|co)$', '') || CASE WHEN regexp_matches(vk, ' pvt ltd$') THEN '|p' WHEN regexp_matches(vk, ' (ltd|limited)$') THEN '|l' WHEN regexp_matches(vk, ' co$') THEN '|c' ELSE '' END
       JOIN ac a ON a.company_key = cn.company_key AND a.debit_account = cn.debit_account LEFT JOIN ac b ON b.company_key = cn.company_key AND b.debit_account = cn.credit_account),
el AS (SELECT *, coalesce(single = debit_account, false) AND targets > 0 AS e0, debit_account NOT IN ('Capital Work in Progress', 'Loan to Director', 'Preliminary Expenses') AS e1, coalesce(gst_paise, 0) = 0 AND NOT taxed AS e3 FROM ct),
ce AS (SELECT *, CAST('0x' || substr(h, 1, 3) AS INTEGER) * 8 + e0::INT + 2 * e1::INT + 4 * e3::INT AS cell FROM el),
c0 AS (SELECT company_key, cell, count(*) AS n, any_value(e0) AS e0, any_value(e1) AS e1, any_value(e3) AS e3 FROM ce GROUP BY ALL),
c1 AS (SELECT *, sum(n) OVER (PARTITION BY company_key) // 20 AS q FROM c0),
t0 AS (SELECT *, greatest(0, least(CASE WHEN e0 THEN n ELSE 0 END, q // 4 + (0 < q % 4)::INT - coalesce(sum(CASE WHEN e0 THEN n ELSE 0 END) OVER w, 0))) AS k0 FROM c1 WINDOW w AS (PARTITION BY company_key ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t1 AS (SELECT *, n - k0 AS n1, greatest(0, least(CASE WHEN e1 THEN n - k0 ELSE 0 END, q // 4 + (1 < q % 4)::INT - coalesce(sum(CASE WHEN e1 THEN n - k0 ELSE 0 END) OVER w, 0))) AS k1 FROM t0 WINDOW w AS (PARTITION BY company_key ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t2 AS (SELECT *, n1 - k1 AS n2, greatest(0, least(n1 - k1, q // 4 + (2 < q % 4)::INT - coalesce(sum(n1 - k1) OVER w, 0))) AS k2 FROM t1 WINDOW w AS (PARTITION BY company_key ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, greatest(0, least(CASE WHEN e3 THEN n2 - k2 ELSE 0 END, q // 4 - coalesce(sum(CASE WHEN e3 THEN n2 - k2 ELSE 0 END) OVER w, 0))) AS k3 FROM t2 WINDOW w AS (PARTITION BY company_key ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nt AS (SELECT ce.*, row_number() OVER (PARTITION BY ce.company_key, ce.cell ORDER BY h, id) AS nth, k0, k1, k2, k3 FROM ce JOIN t3 ON t3.company_key = ce.company_key AND t3.cell = ce.cell),
ty AS (SELECT *, CASE WHEN nth <= k0 THEN 'vendor_switch' WHEN nth <= k0 + k1 THEN 'first_use' WHEN nth <= k0 + k1 + k2 THEN 'magnitude' WHEN nth <= k0 + k1 + k2 + k3 THEN 'gst_anomaly' END AS k, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS draw FROM nt),
g1 AS (SELECT *, draw % greatest(targets, 1) AS x1, least(place, coalesce(other, place)) AS lo, CASE WHEN other IS NOT NULL AND other <> place THEN greatest(place, other) END AS hi FROM ty),
g2 AS (SELECT *, x1 + (x1 >= lo)::INT AS x2 FROM g1),
g3 AS (SELECT *, x2 + coalesce(x2 >= hi, false)::INT AS goes FROM g2),
entries AS (SELECT g.company_key, id, date, party, narration,
  CASE k WHEN 'vendor_switch' THEN p.debit_account WHEN 'first_use' THEN (['Capital Work in Progress', 'Loan to Director', 'Preliminary Expenses'])[draw % 3 + 1] ELSE g.debit_account END AS debit_account, credit_account,
  CASE k WHEN 'magnitude' THEN g.high * ([20, 50, 100])[draw % 3 + 1] ELSE amount_paise END AS amount_paise,
  CASE k WHEN 'gst_anomaly' THEN amount_paise * 1800 // 11800 WHEN 'magnitude' THEN CAST(CAST(g.high * ([20, 50, 100])[draw % 3 + 1] AS HUGEINT) * gst_paise // amount_paise AS BIGINT) ELSE gst_paise END AS gst_paise,
  seq, total, k AS error_type, g.debit_account AS old_account, amount_paise AS old_amount
  FROM g3 g LEFT JOIN ac p ON p.company_key = g.company_key AND p.place = g.goes)"""
_BASE = V.VIEWS.replace("entries AS (", "clean_entries AS (").rstrip() + _CORRUPT
_FLAGS = _BASE + FLAGS[len(V.VIEWS.rstrip()) :]
_SCORED = _FLAGS + ", used AS (SELECT * FROM raw_flags WHERE detector <> 'first_use'), per AS (SELECT company_key, id, count(*) AS n_flags FROM used GROUP BY ALL), scored AS (SELECT e.*, coalesce(n_flags, 0) > 0 AS flagged FROM entries e LEFT JOIN per p ON p.company_key = e.company_key AND p.id = e.id)"


def win_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.inject(V.Book(spark, sf_dir, COLUMNS).entries, RATE, SEED, exact=False)[1]


register("win_inject", win_inject, _BASE + """
SELECT company_key, id, error_type, CASE error_type WHEN 'magnitude' THEN 'amount_paise' WHEN 'gst_anomaly' THEN 'gst_paise' ELSE 'debit_account' END AS field,
  CASE error_type WHEN 'magnitude' THEN CAST(old_amount AS VARCHAR) WHEN 'gst_anomaly' THEN 'none' ELSE old_account END AS was,
  CASE error_type WHEN 'magnitude' THEN CAST(amount_paise AS VARCHAR) WHEN 'gst_anomaly' THEN CAST(gst_paise AS VARCHAR) ELSE debit_account END AS now FROM entries WHERE error_type IS NOT NULL""")

register("jn_truth", lambda s, d: _scored(s, d).select("company_key", "id", "error_type", "flagged"), _SCORED + " SELECT company_key, id, error_type, flagged FROM scored")
register("agg_score", lambda s, d: E.score(_scored(s, d)), _SCORED + """
SELECT company_key, count(*) AS total, count(*) FILTER (error_type IS NULL) AS clean, count(*) FILTER (error_type IS NOT NULL) AS injected, count(*) FILTER (flagged) AS flagged,
  count(*) FILTER (error_type IS NULL AND flagged) AS false_alarms, count(*) FILTER (error_type IS NOT NULL AND flagged) AS caught FROM scored GROUP BY 1""")
register("agg_n1_n2_n3", lambda s, d: E.rates(_scored(s, d), READ, DISMISS), _SCORED + """
, g AS (SELECT company_key, count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (error_type IS NULL) AS clean, count(*) FILTER (error_type IS NULL AND flagged) AS false_alarms FROM scored GROUP BY 1),
t AS (SELECT company_key, error_type, count(*) AS n, count(*) FILTER (flagged) AS hit FROM scored WHERE error_type IS NOT NULL GROUP BY 1, 2),
w AS (SELECT company_key, arg_min(error_type, (CAST(hit AS DOUBLE) / n, error_type)) AS worst, arg_min(hit, (CAST(hit AS DOUBLE) / n, error_type)) AS hit, arg_min(n, (CAST(hit AS DOUBLE) / n, error_type)) AS n, bool_and(hit * 100 >= 90 * n) AS ok FROM t GROUP BY 1)
SELECT company_key, clean, false_alarms, (2 * 10000 * false_alarms + clean) // (2 * clean) AS n1, CASE WHEN false_alarms * 100 <= 10 * clean THEN 'MET' ELSE 'MISSED' END AS n1_verdict,
  (2 * 10000 * flagged * 20 + total * 30) // (2 * total * 30) AS n2, CASE WHEN flagged * 20 * 100 <= 10 * total * 30 THEN 'MET' ELSE 'MISSED' END AS n2_verdict,
  (2 * 10000 * hit + n) // (2 * n) AS n3, worst, CASE WHEN ok THEN 'MET' ELSE 'MISSED' END AS n3_verdict FROM g LEFT JOIN w USING (company_key)""")
register("agg_per_type", lambda s, d: E.per_type(_scored(s, d)), _SCORED + """
, g AS (SELECT error_type, count(*) AS injected, count(*) FILTER (flagged) AS caught FROM scored WHERE error_type IS NOT NULL GROUP BY 1)
SELECT *, (2 * 10000 * caught + injected) // (2 * injected) AS rate, CASE WHEN caught * 100 >= 90 * injected THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")


register("agg_per_detector", lambda s, d: E.per_detector(_scored(s, d), ACTIVE), _SCORED + """
, h AS (SELECT DISTINCT company_key, id, detector FROM used)
SELECT d.detector, count(*) FILTER (s.id IS NOT NULL AND error_type IS NULL) AS false_alarms, count(*) FILTER (error_type IS NOT NULL) AS caught
FROM (VALUES ('vendor_switch'), ('magnitude'), ('gst_anomaly')) d(detector) LEFT JOIN h ON h.detector = d.detector LEFT JOIN scored s ON s.company_key = h.company_key AND s.id = h.id GROUP BY 1""")
GATE = """
, halves AS (SELECT company_key AS ck, CASE WHEN row_number() OVER (ORDER BY company_key) % 2 = 1 THEN 'calibration' ELSE 'held_out' END AS half FROM (SELECT DISTINCT company_key FROM scored)),
g AS (SELECT coalesce(company_key, half, 'all') AS scope, count(*) FILTER (error_type IS NULL) AS clean, count(*) FILTER (error_type IS NULL AND flagged) AS false_alarms
      FROM scored JOIN halves ON ck = company_key GROUP BY GROUPING SETS ((company_key), (half), ()))
SELECT scope, clean, false_alarms, (2 * 10000 * false_alarms + clean) // (2 * clean) AS rate, CASE WHEN false_alarms * 100 <= 10 * clean THEN 'PASS' ELSE 'NOT_PASSED' END AS verdict,
  row_number() OVER (ORDER BY false_alarms / clean DESC, scope) AS place FROM g"""
register("agg_gate", lambda s, d: E.gate(_scored(s, d)), _SCORED + GATE)
register("agg_withdrawn_cost", lambda s, d: E.gate(_scored(s, d, T.BUILT_IN)), _SCORED.replace(" WHERE detector <> 'first_use'), per", "), per") + GATE)
register("top_worst", lambda s, d: E.gate(_scored(s, d)).filter("place = 1"), f"SELECT * FROM ({_SCORED + GATE}) WHERE place = 1")
register("agg_concentration", lambda s, d: E.concentration(_scored(s, d)), _SCORED + """
, b AS (SELECT company_key, debit_account, count(*) AS alarms FROM scored WHERE error_type IS NULL AND flagged GROUP BY ALL),
r AS (SELECT *, sum(alarms) OVER (PARTITION BY company_key) AS a, row_number() OVER (PARTITION BY company_key ORDER BY alarms DESC, debit_account) AS n FROM b)
SELECT company_key, debit_account, alarms, ((2 * 10000 * alarms + a) // (2 * a))::BIGINT AS share FROM r WHERE n = 1 AND alarms >= 2""")


def agg_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, entries = V.book(spark, sf_dir, ("vendor", "party", "debit_account"))
    return E.accuracy(entries, H.vendor_index(history))


register("agg_accuracy", agg_accuracy, LOOKUP + """
, g AS (SELECT company_key, count(*) AS tested, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'match' AND usual = debit_account) AS correct, count(*) FILTER (status = 'conflicted') AS conflicted, count(*) FILTER (status = 'no_match') AS no_match FROM seen GROUP BY 1)
SELECT *, (2 * 10000 * correct + tested) // (2 * tested) AS percent FROM g""")


def _shared_names(rows: DataFrame) -> DataFrame:
    """Companies buy from one pool of suppliers: the number of a supplier modulo ten names it everywhere."""
    return rows.withColumn("party", F.regexp_replace("party", r"#0*\d*(\d) Brand#\d+", "$1"))


def jn_cross_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, entries = V.book(spark, sf_dir, ("party", "debit_account"))
    return E.cross(_shared_names(entries), _shared_names(history))


register("jn_cross_org", jn_cross_org, LOOKUP.replace("FROM history)", "FROM hist)").replace("e0 AS (SELECT * FROM entries)", "e0 AS (SELECT * REPLACE (regexp_replace(party, '#0*[0-9]*([0-9]) Brand#[0-9]+', '\\1') AS party) FROM entries)").replace(", folded AS (", ", hist AS (SELECT * REPLACE (regexp_replace(party, '#0*[0-9]*([0-9]) Brand#[0-9]+', '\\1') AS party) FROM history), folded AS (").replace("FROM history)\n,", "FROM hist)\n,").replace("AS f FROM history)", "AS f FROM hist)") + """
, one AS (SELECT company_key AS source, vendor_key, usual FROM ranked WHERE n = 1), t AS (SELECT company_key AS target, count(*) AS tested FROM ek GROUP BY 1),
c AS (SELECT source, company_key AS target, count(*) AS correct FROM ek JOIN one ON one.vendor_key = ek.vendor_key AND usual = debit_account GROUP BY ALL),
p AS (SELECT a.target AS source, b.target, a.tested AS at_home, b.tested FROM t a JOIN t b ON a.target <> b.target),
r AS (SELECT p.source, p.target, (2 * 10000 * coalesce(h.correct, 0) + at_home) // (2 * at_home) AS home, (2 * 10000 * coalesce(c.correct, 0) + tested) // (2 * tested) AS away
  FROM p LEFT JOIN c ON c.source = p.source AND c.target = p.target LEFT JOIN c h ON h.source = p.source AND h.target = p.source)
SELECT *, home - away AS gap FROM r""")


def win_alt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("company_key"))
    return n.select("company_key", F.when(F.row_number().over(W.orderBy("company_key")) % 2 == 1, "calibration").otherwise("held_out").alias("half"))


register("win_alt_split", win_alt_split, "SELECT n_name AS company_key, CASE WHEN row_number() OVER (ORDER BY n_name) % 2 = 1 THEN 'calibration' ELSE 'held_out' END AS half FROM nation")


def win_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content hash: 60 % development, 20 % validation, the rest locked. Ranks come from hash buckets, so no task sorts all."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    d = d.withColumn("bucket", F.substring("hash", 1, 2))
    sums = d.groupBy("bucket").agg(F.count("*").alias("n"))
    sums = sums.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("all"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("bucket").orderBy("hash", "doc_id"))
    return d.join(sums, "bucket").select("doc_id", F.when(rank * 10 <= F.col("all") * 6, "development").when(rank * 10 <= F.col("all") * 8, "validation").otherwise("locked").alias("part"))


register("win_hash_split", win_hash_split, "SELECT doc_id, CASE WHEN r * 10 <= c * 6 THEN 'development' WHEN r * 10 <= c * 8 THEN 'validation' ELSE 'locked' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(text), doc_id) AS r, count(*) OVER () AS c FROM documents)")


def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that two companies both use: pairs with their number."""
    legs = V.vouchers(spark, sf_dir).select("company_key", "debit_account").distinct()
    b = legs.select(F.col("company_key").alias("other"), "debit_account")
    return legs.join(b, "debit_account").filter("company_key < other").groupBy("company_key", "other").agg(F.count("*").alias("shared"))


register("set_overlap", set_overlap, V.VIEWS + ", l AS (SELECT DISTINCT company_key, debit_account FROM vouchers) SELECT a.company_key, b.company_key AS other, count(*) AS shared FROM l a JOIN l b ON a.debit_account = b.debit_account AND a.company_key < b.company_key GROUP BY ALL")


def win_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose bytes were seen before, with the first that had them; a hot text is one aggregate row, not one task's window."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return d.join(first, "hash").filter("doc_id <> first").select("doc_id", "first")


register("win_first_seen", win_first_seen, "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first")
