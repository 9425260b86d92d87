"""Detectors over whole tables of entries, and the ranking of what they say.

A detector is a function of (entries, history) that returns flags: company_key, id, detector, severity, reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import kept
from .history import lookup, vendor_index, with_vendor

#: Calibrated settings, what each detector is about, and those that are off unless asked for.
MIN_POSTINGS, MIN_OBSERVATIONS, OVER_PERCENT = 2, 2, 300
CONCERNS = {
    "vendor_switch": "which account this entry was posted to",
    "first_use": "which account this entry was posted to",
    "magnitude": "how large this entry is",
    "gst_anomaly": "the tax on this entry",
}
WITHDRAWN = ("first_use",)


def with_ceiling(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Entries with ``seen`` and ``high``: number and largest amount of the account's history on strictly earlier dates.

    History is first summed up by day, so the window runs over an account's days and not its rows.
    """
    days = history.groupBy("company_key", "debit_account", "date").agg(F.max("amount_paise").alias("high"), F.count("*").alias("seen"))
    asked = entries.select("company_key", "debit_account", "date").distinct()
    both = days.unionByName(asked.withColumn("high", F.lit(None).cast("bigint")).withColumn("seen", F.lit(0).cast("bigint")))
    before = W.partitionBy("company_key", "debit_account").orderBy(F.unix_date("date")).rangeBetween(W.unboundedPreceding, -1)
    both = both.select("company_key", "debit_account", "date", F.max("high").over(before).alias("high"), F.coalesce(F.sum("seen").over(before), F.lit(0)).alias("seen"))
    per = both.groupBy("company_key", "debit_account", "date").agg(F.max("high").alias("high"), F.max("seen").alias("seen"))
    return entries.join(per, ["company_key", "debit_account", "date"])


def with_facts(entries: DataFrame, history: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Entries with what the named detectors look at, each table of history joined once.

    accounts, most, status: the vendor's look-up (taken as they are, if the entries have them). account_n, account_tax: number and
    largest tax of the account's history. seen, high: its ceiling on earlier dates.
    """
    if "vendor_switch" in names and "status" not in entries.columns:
        entries = lookup(with_vendor(entries), vendor_index(history), ["stem", "form", "vendor_key"])
    if "first_use" in names or "gst_anomaly" in names:
        per = history.groupBy("company_key", "debit_account").agg(F.count("*").alias("account_n"), F.max(F.coalesce("gst_paise", F.lit(0))).alias("account_tax"))
        entries = entries.join(kept(per), ["company_key", "debit_account"], "left")  # a row per account: entries stay where they are if it is small
    return with_ceiling(entries, history) if "magnitude" in names else entries


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def rules(min_postings: int = MIN_POSTINGS, min_observations: int = MIN_OBSERVATIONS, over_percent: int = OVER_PERCENT) -> dict[str, tuple[int, Column, Column]]:
    """name -> severity, whether an entry with its facts is flagged, and why."""
    c = F.col
    usual = F.get("accounts", F.lit(0))
    return {
        "vendor_switch": (3, (c("status") == "match") & (c("most") >= min_postings) & (usual != c("debit_account")), _text(c("party"), " posted to ", usual, " ", c("most"), " times; this one goes to ", c("debit_account"))),
        "first_use": (2, c("account_n").isNull(), _text(c("debit_account"), " has never been used in this company")),
        "magnitude": (2, (c("seen") >= min_observations) & (c("amount_paise") * 100 > c("high") * over_percent), _text(c("amount_paise"), " paise to ", c("debit_account"), "; of ", c("seen"), " earlier entries the largest is ", c("high"))),
        "gst_anomaly": (3, (c("gst_paise") != 0) & (c("account_tax") == 0), _text("tax of ", c("gst_paise"), " paise on ", c("debit_account"), ", which never carried any across ", c("account_n"), " entries")),
    }


def flagged(rows: DataFrame, names: tuple[str, ...], **settings: int) -> DataFrame:
    """``flags`` of entries with facts: array of (rank, detector, reason), the gravest first; rank is minus the severity."""
    own = rules(**settings)
    made = [F.when(own[n][1], F.struct(F.lit(-own[n][0]).alias("rank"), F.lit(n).alias("detector"), own[n][2].alias("reason"))) for n in names]
    return rows.withColumn("flags", F.array_sort(F.array_compact(F.array(*made))))


def detected(rows: DataFrame, names: tuple[str, ...], **settings: int) -> DataFrame:
    """``detectors`` (names of those that fire) and ``flagged`` of entries with facts, where nobody asks for the reasons."""
    own = rules(**settings)
    fired = F.array_compact(F.array(*[F.when(own[n][1], n) for n in names]))
    return rows.withColumn("detectors", fired).withColumn("flagged", F.coalesce(F.greatest(*[own[n][1] for n in names], F.lit(False)), F.lit(False)))


def _plain(name: str) -> Callable[..., DataFrame]:
    """A built-in detector as a function of (entries, history, its settings) that returns flags."""

    def detector(entries: DataFrame, history: DataFrame, **settings: int) -> DataFrame:
        return _long(flagged(with_facts(entries, history, (name,)), (name,), **settings))

    return detector


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("company_key", "id", F.explode("flags").alias("f")).select("company_key", "id", "f.detector", (-F.col("f.rank")).alias("severity"), "f.reason")


BUILT_IN = ("vendor_switch", "first_use", "magnitude", "gst_anomaly")
DETECTORS: dict[str, Callable[..., DataFrame]] = {n: _plain(n) for n in BUILT_IN}
#: vendor has one past account, often enough, and this entry goes elsewhere; account never used in this company; amount over so many percent of the account's
#: largest earlier one; tax on an account that has history and never carried any.
vendor_switch, first_use, magnitude, gst_anomaly = (DETECTORS[n] for n in BUILT_IN)


def run(entries: DataFrame, history: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """All flags of the named detectors (without names: all but the withdrawn ones). Built-in ones share one pass; plug-ins run by themselves."""
    names = tuple(n for n in DETECTORS if n not in WITHDRAWN) if names is None else names
    own = tuple(n for n in names if n in BUILT_IN and DETECTORS[n] is globals()[n])
    found = [_long(flagged(with_facts(entries, history, own), own))] if own else []
    found += [DETECTORS[n](entries, history).select("company_key", "id", "detector", "severity", "reason") for n in names if n not in own]
    return reduce(DataFrame.unionByName, found)


def concern(detector: Column) -> Column:
    """An unknown detector is a concern of its own."""
    known = F.create_map(*[F.lit(x) for kv in CONCERNS.items() for x in kv])
    return F.coalesce(known[detector], F.concat(F.lit("findings of "), detector))


def ranked(flags: DataFrame, cap: int | None = None) -> DataFrame:
    """One flag per voucher and concern, the gravest leading and the others' reasons behind it; ``place`` from 1, ``dropped`` beyond the cap.

    Flags beyond the cap are kept, marked ``shown`` false.
    """
    if cap is not None and cap < 0:
        raise ValueError(f"a cap of flags cannot be negative: {cap}")
    rank = F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), F.col("detector").alias("d"), F.col("reason").alias("r"))))
    per = flags.groupBy("company_key", "id", concern(F.col("detector")).alias("concern")).agg(rank.alias("all"))
    per = per.select("company_key", "id", "concern", F.col("all")[0]["d"].alias("detector"), (-F.col("all")[0]["s"]).alias("severity"), F.array_join(F.transform("all", lambda x: x["r"]), "; also ").alias("reason"), (F.size("all") - 1).cast("bigint").alias("duplicates"))
    own = W.partitionBy("company_key", "id")
    per = per.withColumn("place", F.row_number().over(own.orderBy(F.desc("severity"), "detector")).cast("bigint"))
    dropped = F.greatest(F.count("*").over(own) - F.lit(cap if cap is not None else 1 << 40), F.lit(0))
    return per.withColumn("dropped", dropped.cast("bigint")).withColumn("shown", F.col("place") <= F.lit(cap if cap is not None else 1 << 40))


def leading(flags: Column) -> Column:
    """Of an entry's sorted flags the first of each concern: what is put to a person, in order."""
    concerns = F.transform(flags, lambda f: concern(f["detector"]))
    return F.filter(flags, lambda f, i: F.array_position(concerns, concern(f["detector"])) == i + 1)
