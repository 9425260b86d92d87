"""From checks, flags and look-ups to problems, and from problems to an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import UNANSWERABLE
from .detect import leading

#: Questions that an entry may cost; the last problem of all.
QUESTIONS, LAST = 5, "funding_is_named"
CHECK_ORDER = ("amount_is_positive", "amount_is_integer_paise", "accounts_differ", "accounts_exist", "funding_is_named", "gst_not_larger_than_amount", "tax_lines_can_be_posted", "party_is_named")


def _order(name: Column) -> Column:
    return F.when(name == LAST, 9_000).otherwise(F.array_position(F.array(*map(F.lit, CHECK_ORDER)), name)).cast("bigint")


def with_problems(rows: DataFrame) -> DataFrame:
    """``problems``: array of (at, problem, answerable) in order, of entries with ``checks``, ``flags`` and the look-up's ``status``.

    Failed checks come first, then the leading flags, then an account that memory can't name, then funding. A problem counts once.
    """
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: F.struct(_order(c["name"]).alias("at"), c["name"].alias("problem"), (~c["name"].isin(*UNANSWERABLE)).alias("answerable")))
    told = F.transform(leading(F.col("flags")), lambda f, i: F.struct((1_001 + i).cast("bigint").alias("at"), f["detector"].alias("problem"), F.lit(True).alias("answerable")))
    which = F.when(F.col("status") != "match", F.array(F.struct(F.lit(5_000).cast("bigint").alias("at"), F.lit("which_account").alias("problem"), F.lit(True).alias("answerable"))))
    every = F.array_sort(F.concat(failed, told, F.coalesce(which, F.array().cast("array<struct<at:bigint,problem:string,answerable:boolean>>"))))
    return rows.withColumn("problems", every)


def listed(rows: DataFrame) -> DataFrame:
    """company_key, id, at, problem, answerable: the problems in long form."""
    return rows.select("company_key", "id", F.inline("problems"))


def outcomes(rows: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """company_key, id, outcome, first, n: one row per entry with ``problems``.

    An unanswerable problem: NOT_VALID. Answerable ones that were all answered before: NOT_VALID. Some outstanding: UNCLEAR with the
    first of them, NOT_VALID once QUESTIONS were asked. None at all: VALID. ``answered``: company_key, id, answered (array), asked.
    """
    none = F.array().cast("array<string>")
    if answered is not None:
        rows = rows.join(answered.select("company_key", "id", "answered", "asked"), ["company_key", "id"], "left")
    else:
        rows = rows.withColumn("answered", none).withColumn("asked", F.lit(0))
    left = F.array_except(F.transform("problems", lambda p: p["problem"]), F.coalesce("answered", none))
    outcome = F.when(F.exists("problems", lambda p: ~p["answerable"]), "NOT_VALID").when(F.size("problems") == 0, "VALID").when(F.size(left) == 0, "NOT_VALID").when(F.coalesce("asked", F.lit(0)) >= QUESTIONS, "NOT_VALID").otherwise("UNCLEAR")
    return rows.select("company_key", "id", outcome.alias("outcome"), F.when(outcome == "UNCLEAR", F.get(left, F.lit(0))).alias("first"), F.size("problems").cast("bigint").alias("n"))


def narrowed(decisions: DataFrame) -> DataFrame:
    """A second opinion (``band``: POST, ASK, BLOCK) may narrow VALID, never widen anything."""
    rank = lambda col, names: F.array_position(F.array(*map(F.lit, names)), F.col(col))
    worst = F.greatest(rank("outcome", ("VALID", "UNCLEAR", "NOT_VALID")), rank("band", ("POST", "ASK", "BLOCK")))
    return decisions.withColumn("outcome", F.when(F.col("outcome") == "VALID", F.element_at(F.array(*map(F.lit, ("VALID", "UNCLEAR", "NOT_VALID"))), worst.cast("int"))).otherwise(F.col("outcome")))
