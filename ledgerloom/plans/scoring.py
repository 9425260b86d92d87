"""Queries that judge readings, place ledgers and describe drafts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import detect as T
from ..operators import fields as P
from ..operators import placement as L
from ..operators import scoring as S
from ..sources import documents as D
from . import views as V
from .evaluation import _FLAGS, COLUMNS, scored
from .ledger import FLAGS
from .reading import _FIGURES, _figures, _printed, bills


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(truth, found): what an order says, and what was read of it: right, wrong, missing, or where there is nothing."""
    o, p = F.col("o_orderkey"), V.paise(F.col("o_totalprice"))
    orders = V.table(spark, sf_dir, "orders")
    row = lambda f, **c: F.struct(F.lit(f).alias("field"), *[x.alias(k) for k, x in c.items()])
    day, none = F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string")
    truth = F.array(
        row("total", status=F.lit("present"), value=_printed(p)), row("date", status=F.when(o % 3 == 0, "absent").otherwise("present"), value=F.when(o % 3 == 0, "").otherwise(day)),
        row("party", status=F.lit("present"), value=F.when(o % 7 == 0, "").otherwise(F.col("o_orderpriority"))), row("number", status=F.lit("present"), value=F.concat(F.lit("INV-"), o.cast("string"))),
    )
    found = F.array(
        row("total", value=F.when(o % 5 == 0, none).when(o % 5 == 1, "1.00").otherwise(F.concat(F.lit("Rs. "), F.format_number(F.col("o_totalprice"), 2)))), row("date", value=F.when((o % 3 == 0) & (o % 2 == 1), none).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))),
        row("party", value=F.concat(F.lit("  "), F.upper("o_orderpriority"))), row("number", value=F.concat(F.lit("inv-"), o.cast("string"))),
    )
    return orders.select(o.alias("doc_id"), F.inline(truth)), orders.select(o.alias("doc_id"), F.inline(found)).filter("value IS NOT NULL")


_VERDICTS = """
WITH v AS (SELECT o_orderkey AS doc_id, unnest(['total', 'date', 'party', 'number']) AS field, unnest([
  CASE o_orderkey % 5 WHEN 0 THEN 'incorrectly unresolved' WHEN 1 THEN CASE WHEN round(o_totalprice * 100) = 100 THEN 'correct' ELSE 'incorrect' END ELSE 'correct' END,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'correct' WHEN o_orderkey % 2 = 1 THEN 'correctly unresolved' ELSE 'false positive' END, CASE WHEN o_orderkey % 7 = 0 THEN 'no truth' ELSE 'correct' END, 'incorrect']) AS verdict FROM orders)"""
register("jn_score_truth", lambda s, d: S.judged(*_slots(s, d)), _VERDICTS + " SELECT * FROM v")
register("agg_field_accuracy", lambda s, d: S.accuracy(S.judged(*_slots(s, d))), _VERDICTS + """
SELECT field, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'false positive') AS false_positive, count(*) FILTER (verdict = 'correctly unresolved') AS correctly_unresolved,
  count(*) FILTER (verdict = 'incorrectly unresolved') AS incorrectly_unresolved, count(*) FILTER (verdict = 'no truth') AS no_truth, count(*) AS slots FROM v GROUP BY 1
UNION ALL SELECT 'whole document', count(*) FILTER (ok), 0, 0, 0, 0, 0, count(*) FROM (SELECT doc_id, bool_and(verdict IN ('correct', 'correctly unresolved')) AS ok FROM v GROUP BY 1)""")


def agg_slot_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of three fields on pages of figures: candidates found, refused, and judged where no person has to."""
    lines = _figures(spark, sf_dir)
    found = P.nearby(lines)
    per = found.groupBy("doc_id", "field").agg(F.count("*").alias("generated"), F.count_if(F.col("rejected") != "").alias("rejected"))
    sure = P.review(found).select("doc_id", "field", F.when(F.col("review"), 0).otherwise(1).alias("judged"))
    slots = lines.groupBy("doc_id").agg(F.count("*").alias("rows")).withColumn("field", F.explode(F.array(*map(F.lit, ("total", "tax", "net")))))
    slots = slots.join(per, ["doc_id", "field"], "left").join(sure, ["doc_id", "field"], "left").fillna(0, ["generated", "rejected", "judged"])
    return S.funnel(slots.withColumn("score", F.when(F.col("judged") > 0, 1.0)))


register("agg_slot_funnel", agg_slot_funnel, """
WITH k AS (SELECT o_orderkey % 7 AS k FROM orders), s AS (
  SELECT 'total' AS field, CASE k WHEN 3 THEN 'no candidate' WHEN 4 THEN 'rejected' WHEN 6 THEN 'label without value' ELSE 'scored' END AS rung FROM k UNION ALL SELECT 'tax', 'no candidate' FROM k UNION ALL SELECT 'net', CASE k WHEN 3 THEN 'scored' ELSE 'no candidate' END FROM k)
SELECT f.field, r.rung, count(s.rung) AS n FROM (VALUES ('total'), ('tax'), ('net')) f(field) CROSS JOIN (VALUES ('no words'), ('no candidate'), ('label without value'), ('rejected'), ('scored')) r(rung) LEFT JOIN s ON s.field = f.field AND s.rung = r.rung GROUP BY 1, 2""")


def agg_slot_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    k = o % 8
    text = F.element_at(F.array(*map(F.lit, ("x", "TOTAL: 5.00 a b c d", "TOTAL: 5.00 a b c d", "GRAND TOTAL 5 a b c d", "TOTEL 5 a b c d", "MONTANT 5 a b c d", "CGST 5 a b c d", "nothing at all here today"))), (k + 1).cast("int"))
    pages = V.table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.upper(text).alias("text"), F.size(F.split(text, " ")).alias("legible"))
    words = pages.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    close = words.join(S.near_misses(words, "total").select("word"), "word", "left_semi").select("doc_id", F.lit("total").alias("field"))
    slots = V.table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.lit("total").alias("field"), k.isin(1, 2).cast("int").alias("located"), F.when(k == 1, 500).alias("value"))
    return S.causes(slots, pages, close).groupBy("cause").agg(F.count("*").alias("n"))


register("agg_slot_cause", agg_slot_cause, """
SELECT (['illegible', 'matched', 'parser', 'label refused', 'label misread', 'unknown label', 'other field''s label', 'no label'])[o_orderkey % 8 + 1] AS cause, count(*) AS n FROM orders GROUP BY 1""")


#: How a label is misprinted, by document: sign of the way, in SQL over ``l`` (the label) and ``k`` (the document's number over that of ways).
_MISPRINTS = ("replace(l, 'O', '0')", "substr(l, 2)", "substr(l, 1, length(l) - 1)", "concat(l, substr(l, 1, 1))", "reverse(l)", "concat(substr(l, 3), substr(l, 1, 2))", "replace(l, 'A', 'XA')", "concat(substr(l, 1, cast(k % 5 as int)), 'Q', substr(l, cast(k % 5 as int) + 2))", "l")


def jn_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, and labels of the total as misprinted by document, that are close to a label."""
    d = V.table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("word"))
    label = F.element_at(F.array(*map(F.lit, P.LABELS["total"])), (F.col("doc_id") % len(P.LABELS["total"]) + 1).cast("int"))
    n = len(_MISPRINTS)
    own = d.filter("doc_id IS NOT NULL").select(label.alias("l"), F.expr(f"doc_id div {n}").alias("k"), (F.col("doc_id") % n).alias("way"))
    made = own.select(F.expr("CASE way " + " ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(_MISPRINTS)) + " END").alias("word"))
    return S.near_misses(words.unionByName(made), "total").select("word", "label", F.round("likeness", 6).alias("likeness"))


#: Matching blocks by recursion: of a stretch of both texts the longest common run (the earliest), then what is left of it and right of it.
register("jn_near_miss", jn_near_miss, f"""
WITH RECURSIVE labels AS (SELECT unnest({list(P.LABELS["total"])!r}) AS label, unnest(range({len(P.LABELS["total"])})) AS place),
made AS (SELECT label AS l, doc_id // {len(_MISPRINTS)} AS k, doc_id % {len(_MISPRINTS)} AS way FROM documents JOIN labels ON place = doc_id % {len(P.LABELS["total"])}),
w AS (SELECT DISTINCT upper(word) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS word FROM documents UNION ALL SELECT CASE way {" ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(_MISPRINTS))} END FROM made) WHERE length(word) >= 3),
pairs AS (SELECT word, label, place FROM w, labels WHERE 2.0 * least(length(word), length(label)) / (length(word) + length(label)) >= 0.78
  AND 2.0 * list_sum(list_transform(list_distinct(string_split(label, '')), lambda c: least(length(label) - length(replace(label, c, '')), length(word) - length(replace(word, c, ''))))) / (length(word) + length(label)) >= 0.78),
starts AS (SELECT *, unnest(range(1, length(label) + 1)) AS j FROM (SELECT word, label, unnest(range(1, length(word) + 1)) AS i FROM pairs)),
runs AS (SELECT word, label, i, j, list_max(list_filter(range(1, least(length(word) - i, length(label) - j) + 2), lambda n: substr(word, i, n) = substr(label, j, n))) AS n FROM starts WHERE substr(word, i, 1) = substr(label, j, 1)),
blocks AS (SELECT word, label, 1::BIGINT AS a, length(word) + 1::BIGINT AS b, 1::BIGINT AS c, length(label) + 1::BIGINT AS d, 0::BIGINT AS size, 0::BIGINT AS at, 0::BIGINT AS bt FROM pairs
  UNION ALL SELECT word, label, x.a, x.b, x.c, x.d, 0, 0, 0 FROM (SELECT m.word, m.label, unnest([{{'a': m.a, 'b': m.i, 'c': m.c, 'd': m.j}}, {{'a': m.i + m.n, 'b': m.b, 'c': m.j + m.n, 'd': m.d}}]) AS x FROM (
    SELECT s.word, s.label, s.a, s.b, s.c, s.d, r.i, r.j, least(r.n, s.b - r.i, s.d - r.j) AS n, row_number() OVER (PARTITION BY s.word, s.label, s.a, s.b, s.c, s.d ORDER BY least(r.n, s.b - r.i, s.d - r.j) DESC, r.i, r.j) AS nth
    FROM blocks s JOIN runs r ON r.word = s.word AND r.label = s.label AND r.i >= s.a AND r.i < s.b AND r.j >= s.c AND r.j < s.d) m WHERE nth = 1) WHERE x.a < x.b AND x.c < x.d),
sizes AS (SELECT word, label, a, b, c, d, max(n) AS n FROM (SELECT s.*, least(r.n, s.b - r.i, s.d - r.j) AS n FROM blocks s JOIN runs r ON r.word = s.word AND r.label = s.label AND r.i >= s.a AND r.i < s.b AND r.j >= s.c AND r.j < s.d) GROUP BY ALL),
l AS (SELECT p.word, p.label, p.place, 2.0::DOUBLE * coalesce(sum(n), 0)::DOUBLE / (length(p.word) + length(p.label))::DOUBLE AS likeness FROM pairs p LEFT JOIN sizes s ON s.word = p.word AND s.label = p.label GROUP BY p.word, p.label, p.place)
SELECT word, arg_max(label, (likeness, -place)) AS label, round(max(likeness), 6) AS likeness FROM l GROUP BY word HAVING max(likeness) >= 0.78""")


def jn_value_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    truth = V.table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.when(o % 11 == 0, "").otherwise(_printed(V.paise(F.col("o_totalprice")))).alias("value"))
    return S.reach(_figures(spark, sf_dir), truth, ("TOTAL",))


register("jn_value_reach", jn_value_reach, "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'absent' ELSE (['same line', 'next line', 'elsewhere', 'same line', 'next line', 'same line', 'next line'])[o_orderkey % 7 + 1] END AS reach FROM orders")


# Drafts


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("amount_paise")
    tier = lambda n: F.element_at(F.array(*map(F.lit, ("typed_text", "stub", "picture", "pdf_text_layer"))), (F.pmod(a + n, F.lit(4)) + 1).cast("int"))
    places = F.when(a % 5 == 0, F.create_map(F.lit("date"), tier(1))).otherwise(F.create_map(F.lit("total_paise"), tier(0), F.lit("date"), tier(1)))
    return V.vouchers(spark, sf_dir).select("id", places.alias("provenance"), F.when(a % 3 == 0, a).alias("net_paise"), F.when(a % 2 == 0, F.when(a % 4 == 0, 0).otherwise(F.col("gst_paise"))).cast("bigint").alias("tax_paise"), a.alias("gross_paise"), (a % 7 == 0).alias("tax_claimed"))


register("dec_doc_kind", lambda s, d: _drafts(s, d).select("id", L.kind_of(F.col("provenance")).alias("kind")), V.VIEWS + "SELECT id, CASE WHEN amount_paise % 5 = 0 THEN 'unsupported' WHEN amount_paise % 4 = 0 THEN 'typed_expense_note' WHEN amount_paise % 4 = 1 THEN 'invoice' ELSE 'unsupported' END AS kind FROM vouchers")
register("dec_situation", lambda s, d: L.situation(_drafts(s, d)).select("id", F.array_join("tiers", ",").alias("tiers"), "lines_total", "has_tax", "tax_read"), V.VIEWS + """
, t AS (SELECT *, CASE WHEN amount_paise % 2 = 0 THEN CASE WHEN amount_paise % 4 = 0 THEN 0 ELSE gst_paise END END AS tax, ['typed_text', 'stub', 'picture', 'pdf_text_layer'] AS n FROM vouchers)
SELECT id, CASE WHEN amount_paise % 5 = 0 THEN n[(amount_paise + 1) % 4 + 1] ELSE array_to_string(list_sort([n[amount_paise % 4 + 1], n[(amount_paise + 1) % 4 + 1]]), ',') END AS tiers,
  CASE WHEN amount_paise % 3 = 0 THEN amount_paise WHEN tax = 0 THEN amount_paise END AS lines_total, CASE WHEN tax IS NULL THEN amount_paise % 7 = 0 ELSE tax <> 0 END AS has_tax, tax IS NOT NULL AS tax_read FROM t""")


def dec_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    outcome = F.when(k == 0, "no_text_layer").when(k == 1, "encrypted").otherwise("read")
    return V.table(spark, sf_dir, "documents").select("doc_id", L.looks_scanned(outcome, F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " Total").otherwise(""))).alias("scanned"))


register("dec_scanned", dec_scanned, f"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE length(trim(x)) < 20 OR NOT regexp_matches(upper(x), '{"|".join(sorted({y for f in ("date", "total", "tax", "cgst", "sgst", "utgst") for y in P.LABELS[f]}))}') END AS scanned
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Total' ELSE '' END AS x FROM documents)""")


def jn_ledger_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, a = V.Book(spark, sf_dir, ("party", "debit_account", "credit_account", "amount_paise")), F.col("amount_paise")
    account = F.col("account")
    parent = F.when(account.startswith("1-"), "Bank Accounts").when(account.startswith("2-"), "Sundry Creditors").when(account.startswith("4-") & (F.col("company_key").rlike("[02468]$|A$")), "Sales Accounts").when(account.startswith("Purchases"), "Purchase Accounts").otherwise("Indirect Expenses")
    chart = own.chart.filter(~account.startswith("3-") & ~account.startswith("5-")).withColumn("parent", parent)
    party = F.when(a % 7 == 0, F.col("credit_account")).when(a % 7 == 1, F.col("debit_account")).otherwise(F.col("party"))
    legs = own.rows.select("company_key", "id", party.alias("party"), F.when(a % 13 == 0, F.lower("debit_account")).when(a % 13 == 1, "").otherwise(F.col("debit_account")).alias("debit_account"), "credit_account")
    return L.ledger_groups(legs, chart).filter("NOT (refused IS NULL AND side = 'debit')")


register("jn_ledger_group", jn_ledger_group, V.VIEWS + """
, ch AS (SELECT *, CASE WHEN starts_with(account, '1-') THEN 'Bank Accounts' WHEN starts_with(account, '2-') THEN 'Sundry Creditors' WHEN starts_with(account, '4-') AND regexp_matches(company_key, '[02468]$|A$') THEN 'Sales Accounts' WHEN starts_with(account, 'Purchases') THEN 'Purchase Accounts' ELSE 'Indirect Expenses' END AS parent
         FROM chart WHERE NOT starts_with(account, '3-') AND NOT starts_with(account, '5-')),
lv AS (SELECT company_key, id, CASE amount_paise % 7 WHEN 0 THEN credit_account WHEN 1 THEN debit_account ELSE party END AS party, CASE amount_paise % 13 WHEN 0 THEN lower(debit_account) WHEN 1 THEN '' ELSE debit_account END AS d, credit_account AS c FROM vouchers),
sd AS (SELECT company_key, id, party, 'debit' AS side, d AS account, c AS counter FROM lv UNION ALL SELECT company_key, id, party, 'credit', c, d FROM lv),
gr AS (SELECT company_key, list(DISTINCT parent) AS g FROM ch GROUP BY 1), lo AS (SELECT DISTINCT company_key, lower(account) AS l FROM ch),
j AS (SELECT s.*, k.parent, b.parent AS beside, lo.l IS NOT NULL AS twin, g, s.account = s.party AND s.counter <> s.party AS is_party FROM sd s LEFT JOIN ch k ON k.company_key = s.company_key AND k.account = s.account LEFT JOIN ch b ON b.company_key = s.company_key AND b.account = s.counter
      LEFT JOIN lo ON lo.company_key = s.company_key AND lo.l = lower(s.account) LEFT JOIN gr ON gr.company_key = s.company_key),
w AS (SELECT *, CASE WHEN (side = 'credit') = (beside = 'Bank Accounts') THEN 'Sundry Debtors' ELSE 'Sundry Creditors' END AS wanted, list_contains(g, 'Bank Accounts')::INT AS money FROM j),
r AS (SELECT *, CASE WHEN account = '' THEN 'no name' WHEN parent IS NOT NULL THEN NULL WHEN twin THEN 'differs in case only' WHEN g IS NULL THEN 'no groups in use'
        WHEN is_party AND (beside IS NULL OR beside NOT IN ('Bank Accounts', 'Purchase Accounts', 'Indirect Expenses', 'Sales Accounts')) THEN 'the other leg doesn''t tell' WHEN is_party AND NOT list_contains(g, wanted) THEN 'group isn''t in use' WHEN is_party THEN NULL
        WHEN side = 'credit' AND list_contains(g, 'Sales Accounts') THEN 'may be income' WHEN side = 'credit' AND money <> 1 THEN 'no single money group' WHEN side = 'credit' THEN NULL ELSE 'a person''s decision' END AS refused FROM w)
SELECT company_key, id, side, account, CASE WHEN refused IS NULL THEN coalesce(parent, CASE WHEN is_party THEN wanted ELSE 'Bank Accounts' END) END AS found, refused FROM r WHERE NOT (refused IS NULL AND side = 'debit')""")


# Cases


def chk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("doc_id")
    money = lambda c: (c.cast("decimal(38,2)") / 100).cast("decimal(38,2)")
    cases = bills(spark, sf_dir).select(
        F.when(o % 96 == 1, o - 1).otherwise(o).alias("case_id"), money(F.col("net")).alias("subtotal"), money(2 * F.col("half")).alias("tax"), money(F.col("grand") + F.when(o % 5 == 0, 1).otherwise(0)).alias("total"),
        F.when(o % 4 == 0, F.array(money(F.col("net") - 7), money(F.lit(7)))).when(o % 4 == 1, F.array(money(F.col("net") - 7))).otherwise(F.array().cast("array<decimal(38,2)>")).alias("items"),
        F.struct(F.col("day"), F.col("grand")).alias("raw"), F.struct(F.when(o % 9 == 0, F.date_add("day", 1)).otherwise(F.col("day")).alias("day"), F.col("grand")).alias("expected"),
    )
    return S.case_faults(cases)


register("chk_corpus", chk_corpus, """
WITH b AS (SELECT DISTINCT l_orderkey AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey), c AS (SELECT o, CASE WHEN o % 96 = 1 THEN o - 1 ELSE o END AS case_id FROM b)
SELECT case_id, 'unbalanced' AS fault FROM c WHERE o % 5 = 0 UNION ALL SELECT case_id, 'items unbalanced' FROM c WHERE o % 4 = 1 UNION ALL SELECT case_id, 'expected isn''t derived' FROM c WHERE o % 9 = 0
UNION ALL SELECT case_id, 'repeated id' FROM c GROUP BY 1 HAVING count(*) > 1""")


def chk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = V.Book(spark, sf_dir, ("party", "debit_account", "amount_paise", "gst_paise"))
    n = F.length("id") % 4
    flags = T.run(book.entries, book.history, T.BUILT_IN).select(F.col("id").alias("voucher"), "detector", "severity", F.when(n == 0, " ").when(n == 1, "no figure").otherwise(F.col("reason")).alias("reason"), F.when(F.length("id") % 5 == 0, "x").otherwise(F.col("id")).alias("proposed"), (F.col("detector") != "gst_anomaly").alias("answerable"))
    return S.flag_faults(flags).groupBy("detector", "fault").agg(F.count("*").alias("n"))


register("chk_flags", chk_flags, FLAGS + """
, f AS (SELECT detector, unnest([CASE length(id) % 4 WHEN 0 THEN 'no reason' WHEN 1 THEN 'cites no number' ELSE CASE WHEN NOT regexp_matches(reason, '[0-9]') THEN 'cites no number' END END, CASE WHEN length(id) % 5 = 0 THEN 'names another voucher' END, CASE WHEN detector = 'gst_anomaly' THEN 'refuses instead of asking' END]) AS fault FROM raw_flags)
SELECT detector, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2""")


def agg_detector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted entries are cases of their detector, clean ones of each."""
    book = V.Book(spark, sf_dir, COLUMNS)
    rows = scored(book, T.BUILT_IN, unsafe=F.length("party") < 20).select("company_key", "id", "date", "error_type", "detectors", "unsafe")  # names stay behind: only this is put in order
    cases = V.placed(rows, book.days).withColumn("detector", F.explode(F.array(*map(F.lit, T.BUILT_IN)))).filter("error_type IS NULL OR error_type = detector")
    cases = cases.select("detector", F.col("error_type").isNotNull().alias("expect_fires"), F.array_contains("detectors", F.col("detector")).alias("fired"), F.lit(False).alias("crashed"), "unsafe", F.coalesce("error_type", F.lit("clean")).alias("label"), F.when(F.col("seq") % 2 == 0, F.col("id")).alias("provenance"))
    return S.detector_counts(cases, T.BUILT_IN)


register("agg_detector_corpus", agg_detector_corpus, _FLAGS + """
, ds AS (SELECT unnest(['vendor_switch', 'first_use', 'magnitude', 'gst_anomaly']) AS detector), cs AS (SELECT d.detector, e.*, r.id IS NOT NULL AS fired FROM entries e JOIN ds d ON e.error_type IS NULL OR e.error_type = d.detector LEFT JOIN raw_flags r ON r.company_key = e.company_key AND r.id = e.id AND r.detector = d.detector)
SELECT detector, count(*) AS cases, count(*) FILTER (fired = (error_type IS NOT NULL)) AS matched, count(*) FILTER (fired) AS fired, 0::BIGINT AS crashed, count(*) FILTER (length(party) < 20) AS unsafe, count(*) AS labelled, count(*) FILTER (seq % 2 = 0) AS with_provenance,
  count(*) FILTER (error_type IS NULL) AS clean, count(*) FILTER (error_type IS NULL AND fired) AS false_alarms FROM cs GROUP BY 1""")


def _taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(types, rows, findings, detectors): types and detectors from part types and segments, a finding per order."""
    types = V.table(spark, sf_dir, "part").select(F.col("p_type").alias("error_type")).distinct().filter(F.length("error_type") % 7 != 0)
    n = F.length("error_type")
    rows = types.filter(n % 5 != 0).select("error_type", F.when(n % 4 == 0, "none").when(n % 3 == 0, "vendor_switch").otherwise("magnitude").alias("detector"), F.element_at(F.array(*map(F.lit, S.ROUTES)), (n % 3 + 1).cast("int")).alias("route"), F.when(n % 4 == 0, "uncovered").when(n % 2 == 0, "partial").otherwise("covered").alias("status"))
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("error_type"))
    findings = V.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("error_type", F.col("l_orderkey").alias("source"), V.paise(F.col("l_extendedprice")).alias("amount"))
    return types, rows, findings, spark.createDataFrame([(d,) for d in T.BUILT_IN], "detector string")


_TAXONOMY = """
WITH pt AS (SELECT DISTINCT p_type AS t, length(p_type) AS n FROM part), ty AS (SELECT * FROM pt WHERE n % 7 <> 0),
rw AS (SELECT t, n, CASE WHEN n % 4 = 0 THEN 'none' WHEN n % 3 = 0 THEN 'vendor_switch' ELSE 'magnitude' END AS d, (['detector', 'rule', 'question'])[n % 3 + 1] AS route, CASE WHEN n % 4 = 0 THEN 'uncovered' WHEN n % 2 = 0 THEN 'partial' ELSE 'covered' END AS status FROM ty WHERE n % 5 <> 0),
fi AS (SELECT p_type AS t, count(*) AS c, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS a FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), de AS (SELECT unnest(['vendor_switch', 'first_use', 'magnitude', 'gst_anomaly']) AS d)"""
register("jn_taxonomy", lambda s, d: S.coverage(*_taxonomy(s, d)), _TAXONOMY + """
SELECT 'covered' AS kind, t AS name, coalesce(c, 0) AS n FROM rw LEFT JOIN fi USING (t) WHERE status <> 'uncovered' UNION ALL SELECT 'type without a row', t, 1 FROM ty WHERE n % 5 = 0 UNION ALL SELECT 'row without a detector', t, 1 FROM rw WHERE d = 'none'
UNION ALL SELECT 'detector without a type', d, 1 FROM de WHERE d NOT IN (SELECT d FROM rw WHERE status <> 'uncovered') UNION ALL SELECT 'finding of unknown type', t, c FROM fi WHERE t NOT IN (SELECT t FROM ty)""")
register("agg_taxonomy", lambda s, d: S.taxonomy_counts(_taxonomy(s, d)[1], _taxonomy(s, d)[2]), _TAXONOMY + """
SELECT 'route' AS kind, r AS name, count(rw.t) AS n FROM (SELECT unnest(['detector', 'rule', 'question', 'external']) AS r) LEFT JOIN rw ON route = r GROUP BY 2 UNION ALL SELECT 'status', s, count(rw.t) FROM (SELECT unnest(['covered', 'partial', 'uncovered']) AS s) LEFT JOIN rw ON status = s GROUP BY 2 UNION ALL SELECT 'amount', t, a FROM fi""")
register("src_documents", lambda s, d: D.described(V.table(s, d, "documents"), "text"), "SELECT doc_id, sha256(text) AS hash, len(string_split(text, chr(12))) AS pages, length(text) AS chars, 'text' AS engine FROM documents")
