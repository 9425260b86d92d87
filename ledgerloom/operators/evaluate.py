"""Measuring the detectors: injected errors, rates, gates, calibration, and indexes across organisations."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import scaled_rate, tax_inside
from ..shared import kept
from .history import lookup, vendor_index, with_vendor

#: False alarms per 100 clean entries at most, review time in percent of reading all at most, catch rate per type in percent at least.
MOST_ALARMS, MOST_REVIEW, LEAST_CAUGHT = 10, 10, 90
#: Kinds of injected error with the field they change, accounts that nothing is posted to, factors on an account's largest amount, claimed tax in basis points.
TYPES = (("vendor_switch", "debit_account"), ("first_use", "debit_account"), ("magnitude", "amount_paise"), ("gst_anomaly", "gst_paise"))
UNPOSTED = ("Capital Work in Progress", "Loan to Director", "Preliminary Expenses")
FACTORS, CLAIMED_TAX = (20, 50, 100), 1800
#: Buckets of a company's shuffled order.
BUCKETS = 4096


def shuffled(seed: int, *columns: str) -> Column:
    """An order that depends on the seed and the columns alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def _context(rows: DataFrame) -> DataFrame:
    """Rows with what eligibility needs: single (the vendor's one account), high and taxed (of the account), places of its legs among the company's accounts."""
    named = with_vendor(rows)
    vendors = named.groupBy("company_key", "vendor_key").agg(F.min("debit_account").alias("__low"), F.max("debit_account").alias("__top"))
    vendors = vendors.select("company_key", "vendor_key", F.when(F.col("__low") == F.col("__top"), F.col("__low")).alias("__single"))
    accounts = rows.groupBy("company_key", "debit_account").agg(F.max("amount_paise").alias("__high"), F.max(F.coalesce("gst_paise", F.lit(0)) != 0).alias("__taxed"))
    own = W.partitionBy("company_key")  # a company's accounts, not its rows
    accounts = accounts.withColumn("__place", F.row_number().over(own.orderBy("debit_account")) - 1).withColumn("__many", F.count("*").over(own))
    accounts = kept(accounts)  # its size is known then: rows stay where they are if it is small
    other = accounts.select("company_key", F.col("debit_account").alias("credit_account"), F.col("__place").alias("__other"))
    named = named.join(vendors, ["company_key", "vendor_key"], "left").join(accounts, ["company_key", "debit_account"]).join(other, ["company_key", "credit_account"], "left")
    return named.select(*rows.columns, "__single", "__high", "__taxed", "__place", "__other", "__many")


def _dealt(rows: DataFrame, rate: Fraction, exact: bool) -> DataFrame:
    """Rows with ``error_type``: quotas as even as possible, each from the rows that its type can be applied to and no type before it took.

    Rows of a company fall into buckets by hash; how many of each bucket and set of eligible types a type takes follows from the
    counts alone, so rows meet only inside their bucket.
    """
    usable = [F.col("__can_" + t) for t, _ in TYPES]
    rows = rows.withColumn("__cell", F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int") * 8 + sum(u.cast("int") * (1 << k) for k, u in enumerate(c for c in usable[:2] + usable[3:])))
    cells = rows.groupBy("company_key", "__cell").agg(F.count("*").alias("__left"), *[F.max(u).alias(f"__ok{k}") for k, u in enumerate(usable)])
    own, before = W.partitionBy("company_key"), W.partitionBy("company_key").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("__all", F.sum("__left").over(own))
    cells = cells.withColumn("__count", F.expr(f"__all * {rate.numerator} div {rate.denominator}"))
    for k in range(len(TYPES)):
        quota = F.expr(f"__count div {len(TYPES)} + int({k} < __count % {len(TYPES)})")
        has = F.when(F.col(f"__ok{k}"), F.col("__left")).otherwise(0)
        take = F.greatest(F.lit(0), F.least(has, quota - F.coalesce(F.sum(has).over(before), F.lit(0))))
        cells = cells.withColumn(f"__take{k}", take.cast("bigint")).withColumn(f"__short{k}", quota - F.sum(has).over(own)).withColumn("__left", F.col("__left") - F.col(f"__take{k}"))
    cells = kept(cells)
    odd = F.count_if(F.col("__all") * rate.numerator % rate.denominator != 0).alias("odd")
    said = cells.agg(odd, *[F.max(F.struct(f"__short{k}", "company_key")).alias(f"s{k}") for k in range(len(TYPES))]).first()
    if exact and said["odd"]:
        raise ValueError(f"{rate} of a company's rows is not a whole number of rows, and a rate asked for exactly is not rounded")
    for k, (name, _) in enumerate(TYPES):
        if said[f"s{k}"] is not None and said[f"s{k}"][0] > 0:
            raise ValueError(f"{name} is short of {said[f's{k}'][0]} eligible rows in {said[f's{k}'][1]}")
    # a type takes from the first cells that it can: rows of cells that nothing is taken from stay where they are
    takes = [f"__take{k}" for k in range(len(TYPES))]
    taken = kept(cells.filter(" + ".join(takes) + " > 0").select("company_key", "__cell", *takes))
    asked = rows.join(taken, ["company_key", "__cell"])
    asked = asked.withColumn("__nth", F.row_number().over(W.partitionBy("company_key", "__cell").orderBy("__hash", "id")))
    upto = [reduce(Column.__add__, [F.col(t) for t in takes[: k + 1]]) for k in range(len(TYPES))]
    asked = asked.withColumn("error_type", F.coalesce(*[F.when(F.col("__nth") <= upto[k], name) for k, (name, _) in enumerate(TYPES)]))
    others = rows.join(taken, ["company_key", "__cell"], "left_anti").withColumn("error_type", F.lit(None).cast("string"))
    return asked.select(*others.columns).unionByName(others)


def injected(rows: DataFrame, rate: Fraction, seed: int, exact: bool = True) -> DataFrame:
    """Rows with ``error_type`` (null: clean), field, was and now; of each company ``rate`` of the rows is corrupted.

    vendor_switch moves a voucher of a vendor with one account to another posted one, never its credit side; first_use to an account that
    nothing is posted to; magnitude raises the amount over the account's largest and scales the tax; gst_anomaly claims tax where the
    account has none. A rate that isn't a whole number of rows is refused, or rounded down if ``exact`` is false; so is a
    type with too few eligible rows. Picks hang on the seed and ids alone.
    """
    clean = F.coalesce("gst_paise", F.lit(0)) == 0
    rest = F.col("__many") - 1 - (F.col("__other").isNotNull() & (F.col("__other") != F.col("__place"))).cast("int")
    own = _context(rows).withColumn("__targets", rest)
    own = own.withColumns({
        "__can_vendor_switch": F.coalesce(F.col("__single") == F.col("debit_account"), F.lit(False)) & (rest > 0), "__can_first_use": ~F.col("debit_account").isin(*UNPOSTED),
        "__can_magnitude": F.lit(True), "__can_gst_anomaly": clean & ~F.col("__taxed"),
    })
    own = _dealt(kept(own).withColumn("__hash", shuffled(seed, "id")), rate, exact)  # written once: read for the counts, then for the rows
    draw = F.conv(F.substring("__hash", 25, 8), 16, 10).cast("bigint")
    low, high = F.least("__place", F.coalesce("__other", F.col("__place"))), F.greatest("__place", F.coalesce("__other", F.lit(-1)))
    at = F.pmod(draw, F.greatest(F.col("__targets"), F.lit(1)))
    at = at + (at >= low).cast("int")
    at = at + ((F.col("__other").isNotNull() & (F.col("__other") != F.col("__place"))) & (at >= high)).cast("int")
    own = own.withColumn("__goes", F.when(F.col("error_type") == "vendor_switch", at))
    posted = rows.select("company_key", F.col("debit_account").alias("__account")).distinct()
    posted = posted.withColumn("__goes", (F.row_number().over(W.partitionBy("company_key").orderBy("__account")) - 1).cast("bigint"))
    posted = kept(posted)
    own = own.join(posted, ["company_key", "__goes"], "left")
    kind = F.col("error_type")
    amount = F.when(kind == "magnitude", F.col("__high") * F.element_at(F.array(*map(F.lit, FACTORS)), (draw % len(FACTORS) + 1).cast("int"))).otherwise(F.col("amount_paise")).cast("bigint")
    scaled = F.expr("cast(cast(__amount as decimal(38,0)) * gst_paise div amount_paise as bigint)")
    own = own.withColumn("__amount", amount)
    new = {
        "debit_account": F.when(kind == "vendor_switch", F.col("__account")).when(kind == "first_use", F.element_at(F.array(*map(F.lit, UNPOSTED)), (draw % len(UNPOSTED) + 1).cast("int"))).otherwise(F.col("debit_account")),
        "amount_paise": F.col("__amount"),
        "gst_paise": F.when(kind == "gst_anomaly", tax_inside(F.col("amount_paise"), F.lit(CLAIMED_TAX))).when(kind == "magnitude", scaled).otherwise(F.col("gst_paise")),
    }
    field = F.create_map(*[F.lit(x) for kv in TYPES for x in kv])[kind]
    pick = lambda values: F.coalesce(*[F.when(field == c, v.cast("string")) for c, v in values.items()])
    was = F.when(kind == "gst_anomaly", "none").otherwise(pick({c: F.col(c) for c in new}))
    own = own.withColumns({"field": field, "was": was, "now": pick(new)} | {f"__new_{c}": v for c, v in new.items()})
    return own.select(*[F.col(f"__new_{c}").alias(c) if c in new else F.col(c) for c in rows.columns], "error_type", "field", "was", "now")


def inject(rows: DataFrame, rate: Fraction, seed: int, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(corrupted rows, truth) as two tables; truth: company_key, id, error_type, field, was, now."""
    own = injected(rows, rate, seed, exact)
    return own.select(*rows.columns), own.filter("error_type IS NOT NULL").select("company_key", "id", "error_type", "field", "was", "now")


def scored(entries: DataFrame, flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Entries with error_type (null: clean), flagged and ``flags``, from separate tables of flags and truth."""
    per = flags.groupBy("company_key", "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("rank"), "detector", "reason"))).alias("flags"))
    rows = entries.join(truth.select("company_key", "id", "error_type"), ["company_key", "id"], "left").join(per, ["company_key", "id"], "left")
    return with_flagged(rows)


def with_flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("flagged", F.coalesce(F.size("flags") > 0, F.lit(False)))


def _counts() -> list[Column]:
    clean = F.col("error_type").isNull()
    return [F.count("*").alias("total"), F.count_if(clean).alias("clean"), F.count_if(~clean).alias("injected"), F.count_if("flagged").alias("flagged"), F.count_if(clean & F.col("flagged")).alias("false_alarms"), F.count_if(~clean & F.col("flagged")).alias("caught")]


def score(rows: DataFrame) -> DataFrame:
    """Per company: total, clean, injected, flagged, false_alarms, caught."""
    return rows.groupBy("company_key").agg(*_counts())


def rates(rows: DataFrame, read_seconds: int, dismiss_seconds: int) -> DataFrame:
    """Per company the three targets, each measured in hundredths and met or missed: in integers, by cross-multiplication.

    n1: false alarms per 100 clean entries. n2: time to dismiss the flagged ones, in percent of the time to read all. n3: catch rate of the worst type
    of injected error (by exact ratio, then by name). Where nothing was measured, the figure is null and the target MISSED.
    """
    if read_seconds < 1 or dismiss_seconds < 1:
        raise ValueError("seconds to read or dismiss an entry are measured, and at least 1")
    clean = F.col("error_type").isNull()
    per = rows.groupBy("company_key", "error_type").agg(F.count("*").alias("n"), F.count_if("flagged").alias("hit"))
    worst = F.min(F.when(~clean, F.struct((F.col("hit").cast("decimal(38,18)") / F.col("n")).alias("share"), "error_type", "hit", "n"))).alias("worst")
    sums = [F.coalesce(F.sum(F.when(clean, F.col(c))), F.lit(0)).alias(a) for c, a in (("n", "clean"), ("hit", "false_alarms"))]
    every = F.bool_and(F.when(~clean, F.col("hit") * 100 >= LEAST_CAUGHT * F.col("n"))).alias("caught")
    r = per.groupBy("company_key").agg(*sums, F.sum("n").alias("total"), F.sum("hit").alias("flagged"), worst, every)
    met = lambda c: F.when(c, "MET").otherwise("MISSED")
    review, whole = F.col("flagged") * dismiss_seconds, F.col("total") * read_seconds
    return r.select(
        "company_key", "clean", "false_alarms", scaled_rate(F.col("false_alarms"), F.col("clean"), 10000).alias("n1"), met((F.col("clean") > 0) & (F.col("false_alarms") * 100 <= MOST_ALARMS * F.col("clean"))).alias("n1_verdict"),
        scaled_rate(review, whole, 10000).alias("n2"), met(review * 100 <= MOST_REVIEW * whole).alias("n2_verdict"),
        scaled_rate(F.col("worst.hit"), F.col("worst.n"), 10000).alias("n3"), F.col("worst.error_type").alias("worst"), met(F.coalesce("caught", F.lit(False))).alias("n3_verdict"),
    )


def per_type(rows: DataFrame) -> DataFrame:
    """Per error type: injected, caught, rate in hundredths of a percent, verdict."""
    per = rows.filter("error_type IS NOT NULL").groupBy("error_type").agg(F.count("*").alias("injected"), F.count_if("flagged").alias("caught"))
    return per.withColumn("rate", scaled_rate(F.col("caught"), F.col("injected"), 10000)).withColumn("verdict", F.when(F.col("caught") * 100 >= LEAST_CAUGHT * F.col("injected"), "PASS").otherwise("FAIL"))


def per_detector(rows: DataFrame, detectors: tuple[str, ...]) -> DataFrame:
    """Per detector, silent ones too: entries falsely alarmed and caught. rows: error_type, and ``detectors`` or ``flags``."""
    fired = F.col("detectors") if "detectors" in rows.columns else F.array_distinct(F.transform("flags", lambda f: f["detector"]))
    hit = rows.select(F.col("error_type").isNull().alias("clean"), F.explode(fired).alias("detector"))
    per = hit.groupBy("detector").agg(F.count_if("clean").alias("false_alarms"), F.count_if(~F.col("clean")).alias("caught"))
    every = rows.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    return every.join(per, "detector", "left").fillna(0)


def gate(rows: DataFrame) -> DataFrame:
    """Scopes all, each half (companies in order of name, alternately) and each company: rate and verdict, worst first.

    Rows are counted once per company; an unmeasured scope has not passed. Ranked by the exact ratio, then by name.
    """
    own = rows.groupBy("company_key").agg(F.count_if(F.col("error_type").isNull()).alias("clean"), F.count_if(F.col("error_type").isNull() & F.col("flagged")).alias("false_alarms"))
    place = F.row_number().over(W.orderBy("company_key"))  # companies, not rows
    own = own.withColumn("half", F.when(place % 2 == 1, "calibration").otherwise("held_out"))
    per = own.groupingSets([["company_key"], ["half"], []], "company_key", "half").agg(F.sum("clean").alias("clean"), F.sum("false_alarms").alias("false_alarms"))
    per = per.withColumn("scope", F.coalesce("company_key", "half", F.lit("all")))
    ok = F.when(F.col("clean") == 0, "NOT_PASSED").when(F.col("false_alarms") * 100 <= MOST_ALARMS * F.col("clean"), "PASS").otherwise("NOT_PASSED")
    worst = F.row_number().over(W.orderBy(F.desc_nulls_last(F.when(F.col("clean") > 0, (F.col("false_alarms").cast("decimal(38,18)") / F.col("clean")))), "scope"))
    return per.select("scope", "clean", "false_alarms", scaled_rate(F.col("false_alarms"), F.col("clean"), 10000).alias("rate"), ok.alias("verdict"), worst.cast("bigint").alias("place"))


def concentration(rows: DataFrame, least: int = 2) -> DataFrame:
    """The account of a company with most false alarms, if it has ``least``; and its share of the company's, in hundredths of a percent."""
    bad = rows.filter("error_type IS NULL AND flagged").groupBy("company_key", "debit_account").agg(F.count("*").alias("alarms"))
    own = W.partitionBy("company_key")
    bad = bad.withColumn("all", F.sum("alarms").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc("alarms"), "debit_account")))
    return bad.filter((F.col("r") == 1) & (F.col("alarms") >= least)).select("company_key", "debit_account", "alarms", scaled_rate(F.col("alarms"), F.col("all"), 10000).alias("share"))


def accuracy(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Per company: tested, matched, correct, conflicted, no_match, percent in hundredths of a percent."""
    seen = lookup(with_vendor(entries), index.drop("raw"), ["stem", "form", "vendor_key"])
    right = (F.col("status") == "match") & (F.get("accounts", F.lit(0)) == F.col("debit_account"))
    per = seen.groupBy("company_key").agg(F.count("*").alias("tested"), F.count_if(F.col("status") == "match").alias("matched"), F.count_if(right).alias("correct"), F.count_if(F.col("status") == "conflicted").alias("conflicted"), F.count_if(F.col("status") == "no_match").alias("no_match"))
    return per.withColumn("percent", scaled_rate(F.col("correct"), F.col("tested"), 10000))


def cross(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Every ordered pair of companies: the first one's index on its own and on the other's entries, and the gap.

    Indexes are joined to entries by vendor, so a pair costs what its names share and not all its rows; pairs without a shared
    name are filled in from the (few) companies.
    """
    index = vendor_index(history).groupBy("company_key", "vendor_key").agg(F.count("*").alias("n"), F.min("account").alias("account")).filter("n = 1").select(F.col("company_key").alias("source"), "vendor_key", "account")
    own = with_vendor(entries).groupBy(F.col("company_key").alias("target"), "vendor_key", "debit_account").agg(F.count("*").alias("c"))
    right = own.join(index, "vendor_key").filter("account = debit_account").groupBy("source", "target").agg(F.sum("c").alias("correct"))
    tested = entries.groupBy(F.col("company_key").alias("target")).agg(F.count("*").alias("tested"))
    names = entries.select(F.col("company_key").alias("source")).distinct()
    every = names.join(tested, F.col("source") != F.col("target"))  # companies, not rows
    home = right.filter("source = target").select("source", F.col("correct").alias("home")).join(tested.select(F.col("target").alias("source"), F.col("tested").alias("at_home")), "source", "right")
    rows = every.join(right, ["source", "target"], "left").join(home, "source")
    away = scaled_rate(F.coalesce("correct", F.lit(0)), F.col("tested"), 10000)
    at_home = scaled_rate(F.coalesce("home", F.lit(0)), F.col("at_home"), 10000)
    return rows.select("source", "target", at_home.alias("home"), away.alias("away"), (at_home - away).alias("gap"))
