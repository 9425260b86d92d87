"""Ledger-shaped views over the supplied tables, as DataFrames, and the same as SQL for the oracles.

A supplier writes its name in several ways (a prefix, a legal form), sells mostly to one account of a company and
sometimes to another. The first half of a company's vouchers, in published order, is history; the rest are entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.history import with_vendor
from ..shared import kept, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paise(c) -> F.Column:
    """A price as integer minor units."""
    return F.round(c * 100).cast("bigint")


def vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_key, id, date, party, narration, debit_account, credit_account, amount_paise, gst_paise."""
    line, orders, supplier, part, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "part", "nation"))
    line = spread(line)
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    prefix = F.when(F.col("s_suppkey") % 3 == 0, "M/s ").otherwise("")
    form = F.element_at(F.array(*map(F.lit, ("", " Ltd", " Limited", " Pvt Ltd", " & Co"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    exempt = F.col("p_brand").startswith("Brand#5")  # goods that carry no tax, on an account of their own
    odd = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 97 == 0
    return rows.select(
        F.col("n_name").alias("company_key"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.to_date("l_shipdate").alias("date"),
        F.concat(prefix, "s_name", F.lit(" "), "p_brand", form).alias("party"),
        F.concat(F.col("p_name"), F.lit(" inv "), F.col("l_orderkey").cast("string")).alias("narration"),
        F.when(odd, F.col("p_type")).when(exempt, "Exempt purchases").otherwise(F.concat(F.lit("Purchases "), (F.col("s_suppkey") % 12).cast("string"))).alias("debit_account"),
        F.col("o_orderpriority").alias("credit_account"),
        paise(F.col("l_extendedprice")).alias("amount_paise"),
        F.when((F.col("l_tax") > 0) & ~exempt, paise(F.col("l_extendedprice") * F.col("l_tax"))).alias("gst_paise"),
    )


def halves(rows: DataFrame) -> DataFrame:
    """With ``seq`` (published order: date, then id) and ``role``: history for the first half of a company, entry after.

    Days are counted first: a day's place in its company comes from the counts, and rows are numbered inside their day only.
    """
    days = rows.groupBy("company_key", "date").agg(F.count("*").alias("__n"))
    own = W.partitionBy("company_key").orderBy(F.col("date").asc_nulls_first())
    days = days.select("company_key", F.col("date").alias("__date"), (F.sum("__n").over(own) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy("company_key")).alias("__total"))
    rows = rows.join(days.withColumnRenamed("company_key", "__company"), (F.col("company_key") == F.col("__company")) & F.col("date").eqNullSafe(F.col("__date")))
    rows = rows.withColumn("seq", (F.col("__before") + F.row_number().over(W.partitionBy("company_key", "date").orderBy("id"))).cast("bigint"))
    rows = rows.withColumn("role", F.when(F.col("seq") <= F.expr("__total div 2"), "history").otherwise("entry"))
    return rows.drop("__company", "__date", "__before", "__total")


def counted(rows: DataFrame) -> DataFrame:
    """company_key, date, n, before, half: vouchers of each day of a company, those of earlier days, and half of all."""
    days = rows.groupBy("company_key", "date").agg(F.count("*").alias("n"))
    own = W.partitionBy("company_key")
    return days.withColumns({"before": F.sum("n").over(own.orderBy(F.col("date").asc_nulls_first())) - F.col("n"), "half": F.expr("sum(n) OVER (PARTITION BY company_key) div 2")})


def cuts(rows: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """company_key, cut: (date, id) of the last voucher of each company's first half, null if it has one voucher only.

    Days are counted (or given, as ``counted``); only vouchers of the one day of a company that holds the middle are put in order.
    """
    own, days = W.partitionBy("company_key"), counted(rows) if days is None else days
    middle = kept(days.filter((F.col("before") < F.col("half")) & (F.col("half") <= F.col("before") + F.col("n"))).select(F.col("company_key").alias("c"), F.col("date").alias("d"), (F.col("half") - F.col("before")).alias("rank")))
    there = rows.select("company_key", "date", "id").join(middle, (F.col("company_key") == F.col("c")) & F.col("date").eqNullSafe(F.col("d")))
    nth = F.row_number().over(own.orderBy("id"))
    return there.withColumn("nth", nth).filter("nth = rank").select("company_key", F.struct("date", "id").alias("cut"))


#: All that a voucher holds besides its company, id and date.
VENDOR = ("stem", "form", "vendor_key")
ALL = ("party", "narration", "debit_account", "credit_account", "amount_paise", "gst_paise")


def placed(entries: DataFrame, days: DataFrame) -> DataFrame:
    """Entries with ``seq``, their number among all vouchers of the company; of ``days`` as all its vouchers are counted.

    An entry stands behind all history and all earlier days, so entries alone are put in order, within their day.
    """
    before = days.select(F.col("company_key").alias("__company"), F.col("date").alias("__date"), F.greatest("before", "half").alias("__before"))
    rows = entries.withColumn("__nth", F.row_number().over(W.partitionBy("company_key", "date").orderBy("id")))
    rows = rows.join(before, (F.col("company_key") == F.col("__company")) & F.col("date").eqNullSafe(F.col("__date")))
    return rows.withColumn("seq", (F.col("__before") + F.col("__nth")).cast("bigint")).drop("__company", "__date", "__before", "__nth")


class Book:
    """What a query asks of the vouchers, from one scan of the tables: the ``columns`` that it needs are written once and read from there.

    ``seq`` orders the vouchers of a company: the pair of date and id, or, if they are to be ``numbered``, their number. A voucher's half follows from
    one cut per company, so neither history nor entries are sorted.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, columns: Sequence[str] = ALL, numbered: bool = False):
        self._spark, self._sf_dir, self._columns, self._numbered = spark, sf_dir, columns, numbered

    @cached_property
    def rows(self) -> DataFrame:
        """company_key, id, date and the columns; ``vendor`` stands for the three columns that its name is taken apart into."""
        rows, columns = vouchers(self._spark, self._sf_dir), list(self._columns)
        if "vendor" in columns:
            columns.remove("vendor")
            columns += VENDOR
            rows = with_vendor(rows)
        return kept(rows.select("company_key", "id", "date", *columns))

    @cached_property
    def days(self) -> DataFrame:
        return kept(counted(self.rows))

    @cached_property
    def vouchers(self) -> DataFrame:
        if self._numbered:
            return kept(halves(self.rows))
        both = self.rows.join(kept(cuts(self.rows, self.days)), "company_key", "left")
        place = F.struct("date", "id")
        return both.withColumn("role", F.when(place <= F.col("cut"), "history").otherwise("entry")).withColumn("seq", place).drop("cut")

    @property
    def history(self) -> DataFrame:
        return self.vouchers.filter("role = 'history'").drop("role")

    @property
    def entries(self) -> DataFrame:
        return self.vouchers.filter("role = 'entry'").drop("role")

    @cached_property
    def chart(self) -> DataFrame:
        return kept(chart_of(self.rows))


def book(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ALL, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(history, entries) of all companies."""
    own = Book(spark, sf_dir, columns, numbered)
    return own.history, own.entries


def chart_of(v: DataFrame) -> DataFrame:
    """company_key, account: what a company keeps; one in eleven of the legs in use is missing from it."""
    legs = v.select("company_key", F.explode(F.array("debit_account", "credit_account")).alias("account")).distinct()
    return legs.filter(F.conv(F.substring(F.md5(F.concat("company_key", F.lit("|"), "account")), 1, 4), 16, 10).cast("int") % 11 != 0)


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, company_key, action, outcome, operation_id: the event stream as an append-only log."""
    e = table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for kv in (("view", "decided"), ("click", "write_attempted"), ("error", "write_outcome_unknown"), ("purchase", "posted"), ("signup", "reversed")) for x in kv])
    outcome = F.create_map(*[F.lit(x) for kv in (("view", "unclear"), ("click", "valid"), ("error", "unknown"), ("purchase", "valid"), ("signup", "not_valid")) for x in kv])
    key = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("seq"), "ts", (F.col("user_id") % 20).cast("string").alias("company_key"), action[F.col("event_type")].alias("action"), outcome[F.col("event_type")].alias("outcome"),
        F.concat_ws("-", F.col("user_id").cast("string"), key).alias("operation_id"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


#: The same views for an oracle; each query's SQL begins with them.
VIEWS = r"""
WITH vouchers AS (
  SELECT n_name AS company_key, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(l_shipdate AS DATE) AS date,
    (CASE WHEN s_suppkey % 3 = 0 THEN 'M/s ' ELSE '' END) || s_name || ' ' || p_brand || (['', ' Ltd', ' Limited', ' Pvt Ltd', ' & Co'])[s_suppkey % 5 + 1] AS party,
    p_name || ' inv ' || l_orderkey AS narration,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN p_type WHEN starts_with(p_brand, 'Brand#5') THEN 'Exempt purchases' ELSE 'Purchases ' || (s_suppkey % 12) END AS debit_account,
    o_orderpriority AS credit_account, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_paise,
    CASE WHEN l_tax > 0 AND NOT starts_with(p_brand, 'Brand#5') THEN CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) END AS gst_paise
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY date, id) AS seq, count(*) OVER (PARTITION BY company_key) AS total FROM vouchers),
history AS (SELECT * FROM numbered WHERE seq <= total // 2),
entries AS (SELECT * FROM numbered WHERE seq > total // 2),
legs AS (SELECT DISTINCT company_key, account FROM (SELECT company_key, debit_account AS account FROM vouchers UNION ALL SELECT company_key, credit_account FROM vouchers)),
chart AS (SELECT * FROM legs WHERE CAST('0x' || substr(md5(company_key || '|' || account), 1, 4) AS INTEGER) % 11 <> 0),
action_log AS (
  SELECT event_id AS seq, ts, CAST(user_id % 20 AS VARCHAR) AS company_key,
    CASE event_type WHEN 'view' THEN 'decided' WHEN 'click' THEN 'write_attempted' WHEN 'error' THEN 'write_outcome_unknown' WHEN 'purchase' THEN 'posted' ELSE 'reversed' END AS action,
    CASE event_type WHEN 'view' THEN 'unclear' WHEN 'click' THEN 'valid' WHEN 'error' THEN 'unknown' WHEN 'purchase' THEN 'valid' ELSE 'not_valid' END AS outcome,
    user_id || '-' || (props ->> 'k') AS operation_id FROM events)
"""
#: Text folding and the supplier's name, as SQL expressions over a column ``party``.
FOLD = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
NAMES = VIEWS + r"""
, folded AS (SELECT *, trim(regexp_replace(lower(party), '[^\p{L}\p{N}]+', ' ', 'g')) AS f FROM {rows}),
stripped AS (SELECT *, CASE WHEN regexp_matches(f, '^m s .') THEN substr(f, 5) WHEN regexp_matches(f, '^ms .') THEN substr(f, 4) WHEN regexp_matches(f, '^messrs .') THEN substr(f, 8) ELSE f END AS p FROM folded),
named AS (SELECT *, CASE
    WHEN regexp_matches(p, '(^| )(private|pvt) (limited|ltd)$') THEN 'pvt_ltd' WHEN regexp_matches(p, '(^| )and (co|company)$') THEN 'and_co'
    WHEN regexp_matches(p, '(^| )(ltd|limited)$') THEN 'ltd' WHEN regexp_matches(p, '(^| )llp$') THEN 'llp' WHEN regexp_matches(p, '(^| )(inc|incorporated)$') THEN 'inc'
    WHEN regexp_matches(p, '(^| )(corp|corporation)$') THEN 'corp' WHEN regexp_matches(p, '(^| )(co|company)$') THEN 'and_co' ELSE '' END AS form,
    trim(regexp_replace(p, '(^| )((private|pvt) (limited|ltd)|and (co|company)|ltd|limited|llp|inc|incorporated|corp|corporation|co|company)$', '')) AS stem FROM stripped),
keyed AS (SELECT *, concat_ws('_', nullif(replace(stem, ' ', '_'), ''), nullif(form, '')) AS vendor_key FROM named)
"""
