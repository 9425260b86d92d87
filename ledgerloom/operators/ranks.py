"""Sums over a total order, ranks and coverage, without a task that holds all rows of a group.

Values are counted first, so a value that many rows share is one row. Rows are dealt to ranges of the order and written with their range's number; what a range
holds is counted, running sums over the few counts say where each range begins, and only inside a range are rows put in order. A rank is looked for in the one range
that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import kept


def _laid(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return kept(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[Column], value: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group before, in the given order, which has to be total inside a group."""
    keys = [F.col(g) for g in group]
    laid = _laid(df, [*keys, *order])
    sums = laid.groupBy(*group, "__range").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("__range") == F.col("__at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    rows = laid.withColumn("__within", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, same)
    return rows.select(*df.columns, (F.col("__start") + F.col("__within")).cast("long").alias(out))


def percentiles(df: DataFrame, group: str, value: str, percents: Sequence[int]) -> DataFrame:
    """``group`` and p<k> for each whole percent k: the value of rank ceil(k n / 100), at least 1, among the group's n values; no interpolation.

    Null values don't count; a group without any has nulls. A null group is one. NaN is above all other values, as in Spark's order.
    """
    known = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    laid = _laid(known, [F.col("g"), F.col("v")])
    ranges = laid.groupBy("g", "__range").agg(F.sum("n").alias("n"))
    own = W.partitionBy("g")
    ranges = ranges.withColumns({"before": F.sum("n").over(own.orderBy("__range")) - F.col("n"), "total": F.sum("n").over(own)})
    asked = F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("p")
    rank = F.greatest(F.lit(1), F.expr("(p * total + 99) div 100"))
    hit = ranges.select("g", "__range", "before", "n", "total", asked).withColumn("rank", rank).filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
    held = hit.select(F.col("g").alias("__g"), F.col("__range").alias("__at"), "p", (F.col("rank") - F.col("before")).alias("rank"))
    rows = laid.join(held, F.col("g").eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__at")))
    upto = F.sum("n").over(W.partitionBy("g", "p").orderBy("v"))
    found = rows.withColumn("upto", upto).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])
    groups = df.select(F.col(group).alias("__group")).distinct()
    return groups.join(wide, F.col("__group").eqNullSafe(F.col("g")), "left").select(F.col("__group").alias(group), *[f"p{p}" for p in percents])


def covered(points: DataFrame, spans: DataFrame) -> DataFrame:
    """id, covers: how much of ``points`` (at, n) each span (id, low, high) holds, both ends included; a null low or high is open at that end, nulls in ``at`` lie in no span.

    A sweep: points and the spans' ends stand in one order, and a span's count is the running sum at its end less that before its start. So the work
    is that of sorting both, whatever the spans overlap. A span whose end is before its start holds nothing.
    """
    per = points.filter("at IS NOT NULL").groupBy("at").agg(F.sum("n").alias("n"))
    ends = spans.select("id", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.col("low").alias("at")), F.struct(F.lit(2).alias("place"), F.col("high").alias("at")))))
    marks = per.select("at", F.lit(1).alias("place"), F.lit(None).cast(spans.schema["id"].dataType).alias("id"), F.col("n").cast("long").alias("n"))
    marks = marks.unionByName(ends.filter("at IS NOT NULL").select("at", "place", "id", F.lit(0).cast("long").alias("n")))
    swept = running(marks, [F.col("at"), F.col("place"), F.col("id")], "n", "before").filter("place <> 1")
    whole = per.agg(F.sum("n").alias("n")).first()["n"] or 0
    sums = swept.groupBy("id").agg(F.max(F.when(F.col("place") == 0, F.col("before"))).alias("start"), F.max(F.when(F.col("place") == 2, F.col("before"))).alias("end"))
    both = spans.select("id", "high", "low").join(sums.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    till = F.when(F.col("high").isNull(), F.lit(whole)).otherwise(F.col("end"))
    return both.select("id", F.greatest(F.lit(0), till - F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("start"))).cast("long").alias("covers"))
