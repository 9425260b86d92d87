"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every copy of a document gets a virtual finish time: the words of its source up to its end, in shuffled order, over the
source's weight. Copies of all sources are range-sorted by that time and taken until the budget is used up. A source
that has no copies left leaves the queue, and the others go on by weight, so the queue itself reshares the excess.
Running sums are made in two levels (sums of ranges, then sums inside a range), so that no source, whatever its share
of the rows, is one task's work, and the number of ranges is Spark's number of shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACED, kept, table

#: Weights of the sources in code point order, again and again; and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """A column for each of ``values``: its sum over all rows before, in the given total order.

    Rows are dealt to ranges of the order and written with their range's number; the ranges' sums (a row per
    shuffle partition, at most) give each range its start, and a window inside each range the rest.
    """
    laid = kept(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumns({f"__{k}": v.cast("long") for k, v in values.items()}))
    sums = laid.groupBy("__range").agg(*[F.sum(f"__{k}").alias(f"__sum_{k}") for k in values])
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("__range").alias("__ranges"), *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__start_{k}") for k in values])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumns({f"__within_{k}": F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) for k in values})
    joined = laid.join(starts, F.col("__range") == F.col("__ranges"), "inner")
    return joined.select(*df.columns, *[(F.col(f"__start_{k}") + F.col(f"__within_{k}")).alias(k) for k in values])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Sources in code point order, null last, weigh ``weights`` in turn. They share the budget (all
    words, if none is given) by weight; no target is above ``most`` times its source's size, and
    the excess goes to the others by weight until none is above. The capped ones are found at
    once: in order of size over weight they are a prefix. A source without words has target 0.
    """
    s = running(sources, [F.col("source").asc_nulls_last()], at=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("long"))
    s = running(s, [(F.col("source_size") / F.col("weight")).asc(), F.col("at").asc()], sizes_before=F.col("source_size"), weights_before=F.col("weight"))
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = int(budget) if budget is not None else int(whole["size"] or 0)
    s = s.withColumn("left", F.lit(total) - most * F.col("sizes_before")).withColumn("weights", F.lit(int(whole["weight"] or 0)) - F.col("weights_before"))
    s = s.withColumn("capped", most * F.col("source_size") * F.col("weights") <= F.col("left") * F.col("weight"))
    level = s.filter(~F.col("capped")).agg(F.min(F.struct(F.col("source_size") / F.col("weight"), F.col("at"), F.col("left"), F.col("weights"))).alias("level")).first()["level"]
    share = F.lit(float(level["left"])) * F.col("weight") / F.lit(int(level["weights"])) if level else F.lit(None).cast("double")
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """All columns and ``size``: the number of words in the text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long"))


def queued(units: DataFrame, most: int = MOST) -> DataFrame:
    """(source, key, words, source_size, weight) to a row per copy, with ``queue``: the words that the queue serves before it.

    Documents of a source stand in order of ``key``; its copies run through them ``most`` times.
    """
    units = running(units, [F.col("source").asc_nulls_last(), F.col("key").asc()], reached=F.col("words"))
    first = units.groupBy("source").agg(F.min("reached").alias("first")).withColumnRenamed("source", "__source")
    units = units.join(first, F.col("source").eqNullSafe(F.col("__source")), "inner").withColumn("before", F.col("reached") - F.col("first")).drop("__source", "reached", "first")
    copies = units.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("before") + F.col("words")) / F.col("weight"))
    return running(copies, [F.col("finish").asc(), F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("round").asc()], queue=F.col("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, and size, source_size, target, taken.

    Columns of ``docs`` with these four names are replaced. The order inside a source is that of an md5 over doc_id and
    text: reruns agree. The copy at which the budget ends is cut there and no other is: together the sources take the
    budget to the word, and each ends within about a document of its target. A document is taken up to ``most`` times.
    Rows of one source that are equal in doc_id and text queue as one and share what it takes evenly, rounded down. Null sources are one
    source; null and empty texts have size 0 and are never taken. Empty tables give no rows.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))
    rows = sized(docs.select("doc_id", "source", "text")).select("source", key.alias("key"), "size")
    units = kept(rows.groupBy("source", "key").agg(F.count("*").alias("n"), F.sum("size").alias("words")))  # used twice below; the texts are read once
    goals = kept(targets(units.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, budget))
    total = int(budget) if budget is not None else int(goals.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    units = units.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")
    copies = queued(units.filter("words > 0").drop("n", "target"), most)
    took = copies.withColumn("took", F.greatest(F.lit(0), F.least("words", F.lit(total) - F.col("queue")))).filter("took > 0")
    took = took.groupBy(F.col("source").alias("__s"), F.col("key").alias("__k")).agg(F.sum("took").alias("took"))
    units = units.join(took, (F.col("key") == F.col("__k")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    size, taken = F.col("words") / F.col("n"), F.floor(F.coalesce("took", F.lit(0)) / F.col("n"))
    units = units.select(F.col("source").alias("__source"), F.col("key").alias("__unit"), size.cast("long").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))
    own = docs.select(F.struct("*").alias("row"), docs["source"].alias("source"), key.alias("__key")).join(units, (F.col("__key") == F.col("__unit")) & F.col("source").eqNullSafe(F.col("__source")), "inner")
    return own.select("row.*", "size", "source_size", "target", "taken")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS pos FROM s),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM n),
b AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS remains,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights FROM w
      WINDOW o AS (ORDER BY source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * weights <= remains * weight AS capped FROM b),
l AS (SELECT remains AS r, weights AS ws FROM c WHERE NOT capped ORDER BY source_size / weight, pos LIMIT 1),
t AS (SELECT source, source_size, weight, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(l.r AS DOUBLE) * weight / CAST(l.ws AS DOUBLE) END AS target FROM c LEFT JOIN l ON true),
u AS (SELECT source, key, count(*) AS n, sum(size)::BIGINT AS words FROM d GROUP BY source, key HAVING sum(size) > 0),
q AS (SELECT u.*, t.source_size, t.weight,
             coalesce(sum(words) OVER (PARTITION BY u.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CAST(k * source_size + before + words AS DOUBLE) / CAST(weight AS DOUBLE) AS finish FROM q, (VALUES (0), (1), (2)) AS e(k)),
g AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source IS NULL, encode(source), key, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queue FROM f),
h AS (SELECT source, key, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - queue)))::BIGINT // any_value(n) AS taken FROM g GROUP BY source, key)
SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target, coalesce(h.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN h ON h.key = d.key AND h.source IS NOT DISTINCT FROM d.source
"""
