"""The append-only log: metrics, first claims, chains, gaps, replays and deletion scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics(log: DataFrame) -> DataFrame:
    """Per company: rows, entries (operations that reached a decision), rows per outcome, writes, reversals one by one and by batch (``batch_id``, if the log has it), replays refused, question rate (null without entries)."""
    entry = F.when(F.col("action") == "decided", F.col("operation_id"))
    asked = F.when((F.col("action") == "decided") & (F.col("outcome") == "unclear"), F.col("operation_id"))
    names = ("valid", "unclear", "not_valid", "unknown")
    bulk = F.col("batch_id") if "batch_id" in log.columns else F.lit(None)
    per = log.groupBy("company_key").agg(
        F.count("*").alias("rows"), F.count_distinct(entry).alias("entries"), F.count_distinct(asked).alias("asked"), *[F.count_if(F.col("outcome") == o).alias(o) for o in names],
        F.count_if(F.col("action") == "write_attempted").alias("writes"), F.count_if(F.col("action") == "write_outcome_unknown").alias("writes_unknown"), F.count_if((F.col("action") == "reversed") & bulk.isNull()).alias("reversals_single"), F.count_if((F.col("action") == "reversed") & bulk.isNotNull()).alias("reversals_bulk"), F.count_if(F.col("action") == "replay_refused").alias("replays_refused"),
    )
    return per.withColumn("question_rate", F.when(F.col("entries") > 0, F.round(F.col("asked") / F.col("entries"), 3))).drop("asked")


def claims(log: DataFrame) -> DataFrame:
    """company_key, operation_id, seq, refused: the first claim of an operation holds for ever; later ones are counted."""
    return log.groupBy("company_key", "operation_id").agg(F.min("seq").alias("seq"), (F.count("*") - 1).alias("refused"))


def chain(events: DataFrame, scope: list[str], state: str, initial: str) -> DataFrame:
    """Events with ``previous`` (the state before, ``initial`` at first) and ``last`` (whether it is the scope's current one)."""
    own = W.partitionBy(*scope).orderBy("seq")
    return events.withColumn("previous", F.lag(state, 1, initial).over(own)).withColumn("last", F.lead("seq").over(own).isNull())


def gaps(events: DataFrame, expected: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes whose recorded chain isn't the expected one: FOREIGN_START, BROKEN (a stated previous state isn't that before), UNKNOWN_SCOPE, MISSING, WRONG_END.

    events: scope, seq, state, stated (the previous state that the row itself states). expected: scope, start, end.
    """
    own = W.partitionBy(*scope).orderBy("seq")
    rows = events.withColumn("before", F.lag("state").over(own))
    per = rows.groupBy(*scope).agg(F.min_by("stated", "seq").alias("first"), F.max_by("state", "seq").alias("end_state"), F.count_if(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("stated"))).alias("broken"), F.lit(True).alias("seen"))
    both = per.join(expected.withColumn("wanted", F.lit(True)), scope, "full")
    why = F.when(F.col("wanted").isNull(), "UNKNOWN_SCOPE").when(F.col("seen").isNull(), "MISSING").when(~F.col("first").eqNullSafe(F.col("start")), "FOREIGN_START").when(F.col("broken") > 0, "BROKEN").when(~F.col("end_state").eqNullSafe(F.col("end")), "WRONG_END")
    return both.select(*scope, why.alias("why")).filter("why IS NOT NULL")


#: Rows of a range of seq that are numbered by one task, or so, if seq has few gaps.
RANGE = 200_000


def _placed(df: DataFrame) -> DataFrame:
    """Rows with ``place``, from 1 by seq, in two levels: ranges of seq, whose counts are offsets, and rows inside a range. Null seqs come first."""
    own = df.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n")).head()
    ranges = own["n"] // RANGE + 1
    width = (own["high"] - own["low"]) // ranges + 1 if own["high"] is not None else 1
    df = df.withColumn("__range", F.coalesce(F.floor((F.col("seq") - F.lit(own["low"])) / F.lit(width)), F.lit(-1)).cast("long"))
    sums = df.groupBy("__range").agg(F.count("*").alias("__n"))
    sums = sums.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row per range
    place = F.col("__before") + F.row_number().over(W.partitionBy("__range").orderBy("seq"))
    return df.join(sums, "__range").withColumn("place", place)


def overwritten(written: DataFrame, read_back: DataFrame, columns: list[str]) -> DataFrame:
    """place, what: rows that differ by position between what was written and what is read (null-safe), missing or added ones included."""
    number = lambda df: _placed(df).select("place", F.struct(*columns).alias("row"))
    both = number(written).withColumnRenamed("row", "a").join(number(read_back).withColumnRenamed("row", "b"), "place", "full")
    what = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "ADDED").otherwise("CHANGED")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("place").cast("bigint").alias("place"), what.alias("what"))


def deletion_scope(log: DataFrame, tenant: str) -> DataFrame:
    """company_key, verdict: companies of a tenant that may be erased, and those that another tenant keeps. log: tenant_id, company_key."""
    pairs = log.select("tenant_id", "company_key").distinct()
    mine, others = pairs.filter(F.col("tenant_id") == tenant).select("company_key"), pairs.filter(F.col("tenant_id") != tenant).select("company_key").distinct().withColumn("__kept", F.lit(True))
    return mine.join(others, "company_key", "left").select("company_key", F.when(F.col("__kept"), "KEEP").otherwise("ERASE").alias("verdict"))


def operations(log: DataFrame) -> DataFrame:
    """Per operation name: n, failures, success rate in hundredths of a percent, mean duration, whole milliseconds."""
    per = log.groupBy("operation").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"), F.sum("ms").alias("ms"))
    return per.select("operation", "n", "failures", F.expr("(2 * 10000 * (n - failures) + n) div (2 * n)").alias("success_rate"), F.expr("ms div n").alias("mean_ms"))


def batch_state(outcomes: DataFrame, order: tuple[str, ...], accounted: DataFrame) -> DataFrame:
    """Per batch the gravest voucher state (``order``: gravest first); COMPLETED with money that isn't accounted for is a CRITICAL_FAILURE."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    per = outcomes.groupBy("batch_id").agg(F.min(rank).alias("r")).join(accounted, "batch_id", "left")
    state = F.element_at(F.array(*map(F.lit, order)), F.col("r").cast("int"))
    return per.select("batch_id", F.when((state == "COMPLETED") & ~F.coalesce("accounted", F.lit(False)), "CRITICAL_FAILURE").otherwise(state).alias("state"))
