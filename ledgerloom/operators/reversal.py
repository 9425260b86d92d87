"""Reversals: candidates, retries, reconciliation, completeness of events, and the state machine of a proposal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import ours

#: States of a voucher in a batch; fields that an event has to have.
RETRYABLE, UNRESOLVED = ("NOT_ATTEMPTED", "FAILED"), ("UNKNOWN", "NOT_ATTEMPTED", "FAILED")
FIELDS = ("company_key", "operation_id", "action", "outcome", "actor", "reason", "ts")
#: The moves of a proposal: event, state before, what has to hold, state after. Both gates have two edges, as the other may have passed or not.
EDGES = (
    ("conservation_passed", "observed", ("not conservation", "not validation"), "observed"), ("conservation_passed", "observed", ("not conservation", "validation"), "checked"),
    ("validation_passed", "observed", ("not validation", "not conservation"), "observed"), ("validation_passed", "observed", ("not validation", "conservation"), "checked"),
    ("conservation_failed", "observed", ("reason",), "blocked"), ("validation_failed", "observed", ("reason",), "blocked"),
    ("confidence_high", "checked", (), "decided"), ("confidence_medium", "checked", (), "asking"), ("confidence_low", "checked", ("reason",), "blocked"),
    ("answered", "asking", ("reason",), "decided"), ("answers_exhausted", "asking", ("reason",), "blocked"),
    ("write_claimed", "decided", ("operation", "high or a person"), "posting"), ("write_confirmed", "posting", ("reason",), "posted"), ("write_failed", "posting", ("reason",), "blocked"),
    ("hard_rule_violated", "observed checked decided asking", ("reason",), "blocked"),
)


def candidates(vouchers: DataFrame) -> DataFrame:
    """What may be reversed: vouchers with our marker, by the operation that it names."""
    return ours(vouchers).select("company_key", "operation_id", "id", "amount_paise")


def in_state(outcomes: DataFrame, states: tuple[str, ...]) -> DataFrame:
    return outcomes.filter(F.col("state").isin(*states))


def reconciled(outcomes: DataFrame, found: DataFrame, readable: Column) -> DataFrame:
    """Unknown outcomes settled against the ledger: absent is REVERSED_VERIFIED, present is NOT_ATTEMPTED; an unreadable ledger settles nothing.

    Only rows that change come out. outcomes: company_key, operation_id, state. found: company_key, operation_id in the ledger now.
    """
    own = outcomes.filter("state = 'UNKNOWN'").join(found.select("company_key", "operation_id", F.lit(True).alias("__there")).distinct(), ["company_key", "operation_id"], "left")
    return own.filter(readable).select("company_key", "operation_id", F.when(F.col("__there"), "NOT_ATTEMPTED").otherwise("REVERSED_VERIFIED").alias("state"))


def completeness(events: DataFrame) -> DataFrame:
    """field, missing, events, complete: how often each field is blank, and how many events have them all."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    whole = F.count_if(~F.greatest(*[blank(c).cast("int") for c in FIELDS]).cast("boolean"))
    one = events.agg(F.count("*").alias("events"), whole.alias("complete"), *[F.count_if(blank(c)).alias(c) for c in FIELDS])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in FIELDS])), "events", "complete")


def folded(events: DataFrame, key: list[str]) -> DataFrame:
    """key, state, illegal: each proposal's moves in order of seq; a move that its state or its guards don't allow changes nothing and is counted.

    events: key, seq, event, reason, operation_id, actor. The fold is a native aggregate over a proposal's own events; proposals are short, and posted and blocked are final.
    """
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    per = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "event", given("reason").alias("reason"), given("operation_id").alias("operation"), given("actor").alias("person")))).alias("moves"))

    def step(s: Column, m: Column) -> Column:
        facts = {"not conservation": ~s["conservation"], "conservation": s["conservation"], "not validation": ~s["validation"], "validation": s["validation"], "reason": m["reason"], "operation": m["operation"], "high or a person": s["sure"] | m["person"]}
        to = F.coalesce(*[F.when(reduce(Column.__and__, [facts[g] for g in guards], (m["event"] == event) & s["state"].isin(*before.split())), after) for event, before, guards, after in EDGES])
        done = to.isNotNull()
        return F.struct(
            F.coalesce(to, s["state"]).alias("state"), (s["conservation"] | done & (m["event"] == "conservation_passed")).alias("conservation"), (s["validation"] | done & (m["event"] == "validation_passed")).alias("validation"),
            (s["sure"] | done & m["event"].isin("confidence_high", "answered")).alias("sure"), (s["illegal"] + (~done).cast("bigint")).alias("illegal"),
        )

    none = F.lit(False)
    start = F.struct(F.lit("observed").alias("state"), none.alias("conservation"), none.alias("validation"), none.alias("sure"), F.lit(0).cast("bigint").alias("illegal"))
    return per.withColumn("s", F.aggregate("moves", start, step)).select(*key, F.col("s.state").alias("state"), F.col("s.illegal").alias("illegal"))


def retained(log: DataFrame, tenants: DataFrame) -> DataFrame:
    """Each row with the deletion mark of its own tenant (null: alive)."""
    return log.join(tenants.select("tenant_id", "deleted_at"), "tenant_id", "left")


def unmet(documents: DataFrame, mandatory: tuple[str, ...]) -> DataFrame:
    """doc_id, missing: mandatory fields less those read, in order."""
    return documents.select("doc_id", F.array_except(F.array(*map(F.lit, mandatory)), "fields").alias("missing"))
