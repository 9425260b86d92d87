"""Tax rules in time and place: look-ups that say why they refuse, and exact computation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import tax_id

#: Reasons for which a rule can't be cited, in order, and authorities that are too weak.
WEAK = ("blog", "forum", "unknown")


def load_rules(rules: DataFrame) -> DataFrame:
    """``rules`` with ``why_not``: the first reason against citing one; null: it is kept."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.coalesce(
        F.when(blank("source_url"), "NO_URL"), F.when(blank("notification_number"), "NO_NUMBER"), F.when(F.col("retrieved_on").isNull(), "NO_RETRIEVAL_DATE"), F.when(F.col("effective_from").isNull(), "NO_EFFECTIVE_DATE"),
        F.when(F.col("authority").isin(*WEAK), "WEAK_AUTHORITY"), F.when(F.col("status") != "active", "NOT_ACTIVE"), F.when(F.col("version").isNull(), "NO_VERSION"), F.when(F.col("rate_basis_points") < 0, "NEGATIVE_RATE"),
    )
    return rules.withColumn("why_not", reason)


def rate_lookup(rows: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """``key``, tax_type, outcome, rule_id, rate: the one rule in force for (code, tax_type) on a day; never the nearest.

    FOUND, CONFLICT (several in force), BEYOND_AMENDMENT_CHECK (the one in force was not checked up to the day), ENDED, NOT_YET,
    NOT_FOUND (the code has no rule of this type), SOURCE_UNVERIFIED (the corpus has no such type at all), in this order.
    Each distinct question (code, type, day) is answered once, however many rows ask it: rules are joined to questions, and answers to rows.
    """
    asked = rows.select(F.col("code").alias("q_code"), F.col("tax_type").alias("q_type"), F.col("on").alias("q_on")).distinct()
    answers = _answered(asked, rules)
    same = F.col("code").eqNullSafe(F.col("q_code")) & F.col("tax_type").eqNullSafe(F.col("q_type")) & F.col("on").eqNullSafe(F.col("q_on"))
    return rows.select(key, "code", "tax_type", "on").join(answers, same).select(key, "tax_type", "outcome", "rule_id", "rate")


def _answered(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """q_code, q_type, q_on, outcome, rule_id, rate of distinct questions."""
    types = rules.select(F.col("tax_type").alias("__t")).distinct().withColumn("__typed", F.lit(True))
    r = rules.select(F.col("code").alias("__c"), F.col("tax_type").alias("__type"), "rule_id", "rate_basis_points", "effective_from", "effective_to", "amendments_checked_through")
    on = F.col("q_on")
    in_force = (F.col("effective_from") <= on) & (F.col("effective_to").isNull() | (F.col("effective_to") >= on))
    joined = asked.join(r, (F.col("q_code") == F.col("__c")) & (F.col("q_type") == F.col("__type")), "left").join(types, F.col("q_type") == F.col("__t"), "left")
    per = joined.groupBy("q_code", "q_type", "q_on").agg(
        F.count_if(in_force).alias("now"), F.count_if(F.col("effective_to") < on).alias("ended"), F.count_if(F.col("effective_from") > on).alias("later"), F.bool_or(F.coalesce("__typed", F.lit(False))).alias("typed"),
        F.min(F.when(in_force, F.struct("rule_id", "rate_basis_points", (F.coalesce(F.col("amendments_checked_through") < on, F.lit(True))).alias("stale")))).alias("one"),
    )
    outcome = (
        F.when(~F.col("typed"), "SOURCE_UNVERIFIED").when(F.col("now") > 1, "CONFLICT").when((F.col("now") == 1) & F.col("one.stale"), "BEYOND_AMENDMENT_CHECK").when(F.col("now") == 1, "FOUND")
        .when(F.col("ended") > 0, "ENDED").when(F.col("later") > 0, "NOT_YET").otherwise("NOT_FOUND")
    )
    found = F.col("outcome") == "FOUND"
    return per.withColumn("outcome", outcome).select("q_code", "q_type", "q_on", "outcome", F.when(found, F.col("one.rule_id")).alias("rule_id"), F.when(found, F.col("one.rate_basis_points")).alias("rate"))


def place_of_supply(rows: DataFrame, states: DataFrame) -> DataFrame:
    """``supply``: INTRA or INTER with the second tax (SGST, UTGST, null for INTER), or a refusal, in order.

    rows: supplier_state, place_state (codes, null: not stated), supplier_id (tax id or null). states: state, territory.
    """
    own = states.select(F.col("state").alias("supplier_state"), F.lit(True).alias("__a"))
    far = states.select(F.col("state").alias("place_state"), F.col("territory").alias("__territory"), F.lit(True).alias("__b"))
    r = rows.join(own, "supplier_state", "left").join(far, "place_state", "left")
    told = F.substring(tax_id(F.col("supplier_id")), 1, 2)
    verdict = (
        F.when(F.col("supplier_state").isNull(), "SUPPLIER_UNKNOWN").when(F.col("place_state").isNull(), "PLACE_UNKNOWN").when(F.col("__a").isNull(), "SUPPLIER_NOT_A_STATE").when(F.col("__b").isNull(), "PLACE_NOT_A_STATE")
        .when(F.col("supplier_id").isNotNull() & told.isNull(), "ID_UNREADABLE").when(told != F.col("supplier_state"), "ID_CONTRADICTS").when(F.col("supplier_state") == F.col("place_state"), "INTRA").otherwise("INTER")
    )
    return r.withColumn("supply", verdict).withColumn("second", F.when(F.col("supply") == "INTRA", F.when(F.col("__territory"), "UTGST").otherwise("SGST"))).drop("__a", "__b", "__territory")


def compute(bills: DataFrame, rules: DataFrame) -> DataFrame:
    """id, outcome, tax: the taxes of each bill (id, taxable, supply, second, code, on), exact to the paisa or not at all.

    A contradicted or unreadable id, or nothing taxable: NOT_VALID; a rate, place or share that can't be told: UNCLEAR; else VALID.
    """
    taxes = F.when(F.col("supply") == "INTRA", F.array(F.lit("CGST"), F.col("second"))).when(F.col("supply") == "INTER", F.array(F.lit("IGST"))).otherwise(F.array().cast("array<string>"))
    lines = bills.withColumn("tax_type", F.explode_outer(taxes))
    rates = rate_lookup(lines.filter("tax_type IS NOT NULL").select("id", "tax_type", "code", "on"), rules)
    lines = lines.join(rates, ["id", "tax_type"], "left")
    top = F.col("taxable") * F.col("rate")
    exact = F.when(top % 10000 == 0, (top / 10000).cast("bigint"))
    per = lines.groupBy("id").agg(F.first("supply").alias("supply"), F.first("taxable").alias("taxable"), F.count("tax_type").alias("n"), F.count(exact).alias("known"), F.sum(exact).alias("tax"))
    outcome = F.when(F.col("supply").isin("ID_CONTRADICTS", "ID_UNREADABLE") | (F.col("taxable") <= 0), "NOT_VALID").when((F.col("n") == 0) | (F.col("known") < F.col("n")), "UNCLEAR").otherwise("VALID")
    return per.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "VALID", F.col("tax")).alias("tax"))


def ledger_map(lines: DataFrame, names: DataFrame, chart: DataFrame) -> DataFrame:
    """company_key, id, outcome, missing: all tax lines of a voucher have a ledger in the chart, or none is mapped."""
    want = lines.join(names, "tax_type", "left")
    kept = chart.select("company_key", F.col("account").alias("ledger"), F.lit(True).alias("__in"))
    per = want.join(kept, ["company_key", "ledger"], "left").groupBy("company_key", "id").agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("all"), F.array_sort(F.collect_set(F.when(F.col("__in").isNull(), F.coalesce("ledger", "tax_type")))).alias("missing"))
    return per.select("company_key", "id", F.when(F.col("all"), "MAPPED").otherwise("LEDGER_MISSING").alias("outcome"), "missing")


def period_open(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """``period``: OPEN or CLOSED by the company's bounds (inclusive; a year ends the day before the next begins); UNVERIFIED without them."""
    p = periods.select("company_key", "starts", F.coalesce("ends", F.date_sub(F.add_months("starts", 12), 1)).alias("__ends"))
    r = rows.join(p, "company_key", "left")
    state = F.when(F.col("starts").isNull(), "UNVERIFIED").when(F.col("date").between(F.col("starts"), F.col("__ends")), "OPEN").otherwise("CLOSED")
    return r.withColumn("period", state).drop("starts", "__ends")
