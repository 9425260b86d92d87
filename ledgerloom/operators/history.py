"""What a company's history teaches: indexes of vendors and phrases, funding, balances; and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

NO_MATCH, MATCH, CONFLICTED = "no_match", "match", "conflicted"


def with_vendor(rows: DataFrame) -> DataFrame:
    """``stem``, ``form`` and ``vendor_key`` of the party; rows that have them already stay as they are."""
    if {"stem", "form", "vendor_key"} <= set(rows.columns):
        return rows
    n = X.supplier_name(F.col("party"))
    return rows.withColumns({"stem": n["stem"], "form": n["form"]}).withColumn("vendor_key", X.joined_key(F.col("stem"), F.col("form")))


def _indexed(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Per subject and account: how often, and the subject's first raw name. A row per pair, whatever their postings: ``sources`` lists those."""
    usable = rows.filter((F.col(keys[-1]) != "") & (F.coalesce(F.col("debit_account"), F.lit("")) != ""))
    per = usable.groupBy("company_key", *keys, "debit_account").agg(
        F.count("*").alias("times"), F.min(F.struct("seq", raw)).alias("__first")
    )
    first = F.min("__first").over(W.partitionBy("company_key", *keys))
    return per.withColumn("raw", first[raw]).drop("__first").withColumnRenamed("debit_account", "account")


def vendor_index(history: DataFrame) -> DataFrame:
    """company_key, stem, form, vendor_key, account, times, raw."""
    return _indexed(with_vendor(history), ["stem", "form", "vendor_key"], "party")


def phrase_index(history: DataFrame) -> DataFrame:
    """company_key, phrase, account, times, raw."""
    return _indexed(history.withColumn("phrase", X.phrase_key(F.col("narration"))), ["phrase"], "narration")


def sources(history: DataFrame, every: int = 10_000) -> DataFrame:
    """company_key, vendor_key, account, chunk, ids: the postings behind an index row, in published order, in lists of at most ``every``.

    A chunk holds postings of consecutive ``every`` numbers of the company, so a hot pair is many rows, none of them long.
    """
    own = with_vendor(history).filter((F.col("vendor_key") != "") & (F.coalesce(F.col("debit_account"), F.lit("")) != ""))
    per = own.groupBy("company_key", "vendor_key", F.col("debit_account").alias("account"), F.expr(f"(seq - 1) div {int(every)}").alias("chunk"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda s: s["id"]).alias("ids"))


def ranked(index: DataFrame, keys: list[str]) -> DataFrame:
    """Per subject its accounts, most often used first, then by name; status match or conflicted."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("t"), F.col("account").alias("a"))))
    per = index.groupBy("company_key", *keys).agg(F.transform(order, lambda s: s["a"]).alias("accounts"), F.max("times").alias("most"))
    return per.withColumn("status", F.when(F.size("accounts") == 1, MATCH).otherwise(CONFLICTED))


def lookup(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with accounts, most and status; a blank subject never matches."""
    per = ranked(index, keys)
    found = rows.join(per, ["company_key", *keys], "left")
    return found.withColumn("status", F.coalesce("status", F.lit(NO_MATCH))).withColumn("accounts", F.coalesce("accounts", F.array().cast("array<string>")))


def bootstrap_report(history: DataFrame, chart: DataFrame) -> DataFrame:
    """Per company: vouchers, vendors, accounts, mappings, conflicts, unusable rows, and whether the index may be used."""
    rows = with_vendor(history)
    usable = (F.col("vendor_key") != "") & (F.coalesce(F.col("debit_account"), F.lit("")) != "")
    counts = rows.groupBy("company_key").agg(F.count("*").alias("vouchers"), F.count_if(~usable).alias("unusable"))
    index = rows.filter(usable).groupBy("company_key", "vendor_key").agg(F.count_distinct("debit_account").alias("n"))
    index = index.groupBy("company_key").agg(F.count("*").alias("vendors"), F.sum("n").alias("mappings"), F.count_if(F.col("n") > 1).alias("conflicts"))
    accounts = chart.groupBy("company_key").agg(F.count_distinct("account").alias("accounts"))
    out = accounts.join(counts, "company_key", "full").join(index, "company_key", "left")
    out = out.select("company_key", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("vouchers", "vendors", "accounts", "mappings", "conflicts", "unusable")])
    return out.withColumn("readiness", F.when(F.col("vouchers") == 0, "EMPTY_SOURCE").when(F.col("vendors") == 0, "EMPTY_VENDOR_INDEX").otherwise("READY"))


def funding(history: DataFrame) -> DataFrame:
    """Per vendor the credit account, if all its postings agree on one; else null."""
    own = with_vendor(history).filter(F.col("vendor_key") != "").groupBy("company_key", "vendor_key").agg(F.count_distinct("credit_account").alias("n"), F.min("credit_account").alias("one"))
    return own.select("company_key", "vendor_key", F.when(F.col("n") == 1, F.col("one")).alias("funding"))


def legs(rows: DataFrame) -> DataFrame:
    """company_key, account, paise: debits positive, credits negative."""
    two = F.array(F.struct(F.col("debit_account").alias("account"), F.col("amount_paise").alias("paise")), F.struct(F.col("credit_account").alias("account"), (-F.col("amount_paise")).alias("paise")))
    return rows.select("company_key", F.inline(two))


def trial_balance(rows: DataFrame) -> DataFrame:
    """Balances that aren't zero; those of a company sum to zero."""
    return legs(rows).groupBy("company_key", "account").agg(F.sum("paise").alias("balance")).filter("balance <> 0")


def balance_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ledgers that moved between two trial balances; an absent ledger is at zero."""
    a, b = before.withColumnRenamed("balance", "__a"), after.withColumnRenamed("balance", "__b")
    moved = F.coalesce("__b", F.lit(0)) - F.coalesce("__a", F.lit(0))
    return a.join(b, ["company_key", "account"], "full").select("company_key", "account", moved.alias("moved")).filter("moved <> 0")


def stale_memory(index: DataFrame, live: DataFrame) -> DataFrame:
    """Subjects whose one remembered account isn't the set that live history gives."""
    remembered = ranked(index, ["vendor_key"]).filter("status = 'match'").select("company_key", "vendor_key", F.col("accounts")[0].alias("remembered"))
    now = with_vendor(live).filter("vendor_key <> ''").groupBy("company_key", "vendor_key").agg(F.array_sort(F.collect_set("debit_account")).alias("live"))
    return remembered.join(now, ["company_key", "vendor_key"]).filter(F.col("live") != F.array("remembered"))


def key_collisions(names: DataFrame) -> DataFrame:
    """Keys to which two different names fold: company, names, in order."""
    per = names.select(X.company_key(F.col("company")).alias("key"), X.composed(F.col("company")).alias("company")).groupBy("key").agg(F.array_sort(F.collect_set("company")).alias("names"))
    return per.filter(F.size("names") > 1)


def missing_accounts(rows: DataFrame, chart: DataFrame) -> DataFrame:
    """Named legs that the company's chart doesn't have: id, side, account."""
    sides = F.array(F.struct(F.lit("debit").alias("side"), F.col("debit_account").alias("account")), F.struct(F.lit("credit").alias("side"), F.col("credit_account").alias("account")))
    named = rows.select("company_key", "id", F.inline(sides)).filter("account <> ''")
    return named.join(chart, ["company_key", "account"], "left_anti").select("company_key", "id", "side", "account")


def in_range(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Vouchers of an inclusive range of dates; one without a date is in none."""
    return rows.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def ledger(rows: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """Vouchers of the range that touch a ledger as party, debit or credit."""
    return in_range(rows, first, last).filter(F.lit(name).isin(F.col("party"), F.col("debit_account"), F.col("credit_account")))


def ours(rows: DataFrame) -> DataFrame:
    """Vouchers that carry our marker, with the operation it names."""
    return rows.withColumn("operation_id", X.operation_in(F.col("narration"))).filter("operation_id IS NOT NULL")
