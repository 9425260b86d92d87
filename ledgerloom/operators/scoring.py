"""Reading judged against truth: where values are lost, why labels don't match, which fields are right; and corpora of cases judged as such."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import reading as R
from .fields import LABELS

#: Statuses of a truth that has nothing to find; rungs a field's slot can land on; words rows of a legible page; likeness of a misread label.
NOTHING = ("ABSENT", "AMBIGUOUS", "UNREADABLE")
RUNGS = ("no words", "no candidate", "label without value", "rejected", "scored")
LEGIBLE_WORDS, CLOSE = 5, 0.78
#: Words that mean what a label means.
HINTS = {"total": ("TOTAL", "AMOUNT", "PAYABLE", "DUE", "BALANCE", "SUM", "MONTANT"), "tax": ("TAX", "GST", "VAT", "CGST", "SGST", "IGST", "TVA", "DUTY"), "net": ("SUBTOTAL", "SUB TOTAL", "NET", "TAXABLE", "PRE-TAX", "BEFORE TAX")}
KINDS = {"total": "money", "tax": "money", "net": "money", "party": "party", "date": "date"}


def judged(truth: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, field, verdict: every slot of the truth (doc_id, field, status, value) against what was read (doc_id, field, value).

    Money is equal by its paise, a party but for case and spacing, a date by its day, all else by its characters. ``verdict``: correct, incorrect, false positive (there is
    nothing to find), correctly unresolved, incorrectly unresolved, no truth (a status without a value).
    """
    rows = truth.select("doc_id", "field", F.upper(F.coalesce("status", F.lit(""))).alias("status"), F.coalesce("value", F.lit("")).alias("want")).join(found.select("doc_id", "field", F.col("value").alias("got")), ["doc_id", "field"], "left")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("field")]
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    same = (
        F.when(kind == "money", R.paise(F.col("got")) == R.paise(F.col("want"))).when(kind == "party", plain(F.col("got")) == plain(F.col("want")))
        .when(kind == "date", R.date(F.col("got"), R.DAY_FIRST)["value"] == R.date(F.col("want"), R.DAY_FIRST)["value"]).otherwise(F.trim("got") == F.trim("want"))
    )
    empty = F.col("status").isin(*NOTHING)
    verdict = F.when(~empty & (F.col("want") == ""), "no truth").when(F.col("got").isNull(), F.when(empty, "correctly unresolved").otherwise("incorrectly unresolved")).when(empty, "false positive").when(F.coalesce(same, F.lit(False)), "correct").otherwise("incorrect")
    return rows.select("doc_id", "field", verdict.alias("verdict"))


VERDICTS = ("correct", "incorrect", "false positive", "correctly unresolved", "incorrectly unresolved", "no truth")


def accuracy(verdicts: DataFrame) -> DataFrame:
    """Per field the number of each verdict; and a row for whole documents: those with every field right, and all."""
    right = F.col("verdict").isin("correct", "correctly unresolved")
    per = verdicts.groupBy("field").agg(*[F.count_if(F.col("verdict") == v).alias(v.replace(" ", "_")) for v in VERDICTS], F.count("*").alias("slots"))
    docs = verdicts.groupBy("doc_id").agg(F.bool_and(right).alias("right")).agg(F.count_if("right").alias("correct"), F.count("*").alias("slots"))
    whole = docs.select(F.lit("whole document").alias("field"), "correct", *[F.lit(0).cast("bigint").alias(v.replace(" ", "_")) for v in VERDICTS[1:]], "slots")
    return per.unionByName(whole)


def rungs(slots: DataFrame) -> DataFrame:
    """``rung`` of each slot: doc_id, field, rows (word rows of the page), generated, rejected, judged (candidates), score."""
    seen = (F.col("judged") > 0) & ~F.coalesce(F.col("score") == 0.0, F.lit(False))
    return slots.withColumn("rung", F.when(F.col("rows") == 0, RUNGS[0]).when(F.col("generated") == 0, RUNGS[1]).when(seen, RUNGS[4]).when((F.col("rejected") > 0) | (F.col("judged") > 0), RUNGS[3]).otherwise(RUNGS[2]))


def funnel(slots: DataFrame) -> DataFrame:
    """field, rung, n: every slot lands on one rung; rungs without any are there too."""
    own = rungs(slots)
    every = own.select("field").distinct().withColumn("rung", F.explode(F.array(*map(F.lit, RUNGS))))
    return every.join(own.groupBy("field", "rung").agg(F.count("*").alias("n")), ["field", "rung"], "left").fillna(0, ["n"])


def ceiling(word: Column, label: str) -> Column:
    """What the likeness of a word and a label can be at most: twice the characters that both have, however they stand, over all characters of both.

    A matching block's characters are in both texts, so no likeness is above it.
    """
    has = lambda c: F.length(word) - F.length(F.replace(word, F.lit(c), F.lit("")))
    both = sum((F.least(has(c), F.lit(label.count(c))) for c in sorted(set(label))), F.lit(0))
    return 2.0 * both / (F.length(word) + len(label))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters of both: the longest common run first, then the same on its left and right."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def near_misses(words: DataFrame, field: str) -> DataFrame:
    """word, label, likeness: of distinct words (of 3 characters or more) the closest label of a field, if it is CLOSE; ties go to the earlier label.

    Words are made distinct first, so a page's repeats cost nothing; then those that can't be close (by their length and the characters that they share
    with a label) go, without leaving the JVM; blocks are matched for what is left.
    """
    own = words.select(F.upper("word").alias("word")).distinct().filter(F.length("word") >= 3)
    maybe = F.array_compact(F.array(*[F.when(ceiling(F.col("word"), x) >= CLOSE, F.struct(F.lit(-k).alias("place"), F.lit(x).alias("label"))) for k, x in enumerate(LABELS[field])]))
    pairs = own.select("word", F.inline(maybe)).withColumn("likeness", likeness("word", "label")).filter(F.col("likeness") >= CLOSE)
    return pairs.groupBy("word").agg(F.max(F.struct("likeness", "place", "label")).alias("b")).select("word", "b.label", "b.likeness")


def causes(slots: DataFrame, pages: DataFrame, close: DataFrame) -> DataFrame:
    """doc_id, field, cause: why a field's label wasn't matched; the first of eight that holds.

    slots: doc_id, field, located (labels that matched), value. pages: doc_id, text (upper case), legible (word rows with characters). close: doc_id, field
    of pages with a near miss.
    """
    rows = slots.join(pages, "doc_id").join(close.select("doc_id", "field", F.lit(True).alias("close")).distinct(), ["doc_id", "field"], "left")
    holds = lambda words: F.col("text").rlike("|".join(w.replace("-", r"\-").replace("#", r"\#") for w in words))
    own = F.coalesce(*[F.when(F.col("field") == f, holds(LABELS[f])) for f in HINTS])
    hint = F.coalesce(*[F.when(F.col("field") == f, holds(HINTS[f])) for f in HINTS])
    other = F.coalesce(*[F.when(F.col("field") == f, holds([x for g in HINTS if g != f for x in LABELS[g]])) for f in HINTS])
    cause = (
        F.when(F.col("legible") < LEGIBLE_WORDS, "illegible").when((F.col("located") > 0) & F.col("value").isNull(), "parser").when(F.col("located") > 0, "matched").when(own, "label refused")
        .when(F.coalesce("close", F.lit(False)), "label misread").when(hint, "unknown label").when(other, "other field's label").otherwise("no label")
    )
    return rows.select("doc_id", "field", cause.alias("cause"))


def reach(lines: DataFrame, truth: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """doc_id, reach: where a known value (truth: doc_id, value) stands beside a label: no words, absent, no label, same line, next line, elsewhere.

    Lines are looked at once; a label's line and the one after it are compared by their numbers, never in pairs.
    """
    plain = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    own = lines.filter(F.trim("text") != "").join(truth.select("doc_id", plain(F.col("value")).alias("want")), "doc_id")
    text = plain(F.col("text"))
    own = own.select("doc_id", "line_no", text.rlike("|".join(labels)).alias("labelled"), ((F.col("want") != "") & F.contains(text, F.col("want"))).alias("has"))
    per = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("labelled").alias("any_label"), F.bool_or("has").alias("any_value"), F.bool_or(F.col("labelled") & F.col("has")).alias("same"), F.collect_set(F.when(F.col("labelled"), F.col("line_no") + 1)).alias("after"), F.collect_set(F.when(F.col("has"), F.col("line_no"))).alias("at"))
    rows = truth.select("doc_id").join(per, "doc_id", "left")
    said = F.when(F.col("n").isNull(), "no words").when(~F.col("any_label"), "no label").when(~F.col("any_value"), "absent").when(F.col("same"), "same line").when(F.arrays_overlap("after", "at"), "next line").otherwise("elsewhere")
    return rows.select("doc_id", said.alias("reach"))


# Corpora of cases


def case_faults(cases: DataFrame) -> DataFrame:
    """case_id, fault: what is wrong with a labelled case: subtotal + tax isn't the total, items aren't the subtotal, the expected answer isn't the raw truth's, an id occurs twice.

    cases: case_id, subtotal, tax, total, items (array), raw and expected (structs alike).
    """
    items = F.aggregate("items", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("repeated id").alias("fault"))
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("subtotal") + F.col("tax") == F.col("total"), F.lit(False)), "unbalanced"), F.when((F.size("items") > 0) & (items != F.col("subtotal")), "items unbalanced"), F.when(~F.col("expected").eqNullSafe(F.col("raw")), "expected isn't derived"),
    ))
    return cases.select("case_id", F.explode(faults).alias("fault")).unionByName(twice)


def flag_faults(flags: DataFrame) -> DataFrame:
    """voucher, detector, fault: flags (voucher, detector, severity, reason, proposed, answerable) that say nothing, cite no number, name another voucher, or refuse an entry outright."""
    reason = F.coalesce(F.trim("reason"), F.lit(""))
    faults = F.array_compact(F.array(
        F.when(reason == "", "no reason"), F.when((reason != "") & ~reason.rlike("[0-9]"), "cites no number"), F.when(~F.col("voucher").eqNullSafe(F.col("proposed")), "names another voucher"), F.when(~F.coalesce("answerable", F.lit(True)), "refuses instead of asking"),
    ))
    return flags.select("voucher", "detector", F.explode(faults).alias("fault"))


def detector_counts(results: DataFrame, detectors: tuple[str, ...]) -> DataFrame:
    """Per detector, silent ones too: cases, matched, fired, crashed, unsafe, labelled, with_provenance, clean, false_alarms.

    results: detector, expect_fires, fired, crashed, unsafe, label, provenance.
    """
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    per = results.groupBy("detector").agg(
        F.count("*").alias("cases"), F.count_if((F.col("expect_fires") == F.col("fired")) & ~F.col("crashed")).alias("matched"), F.count_if("fired").alias("fired"), F.count_if("crashed").alias("crashed"), F.count_if("unsafe").alias("unsafe"),
        F.count_if(given("label")).alias("labelled"), F.count_if(given("provenance")).alias("with_provenance"), F.count_if(~F.col("expect_fires")).alias("clean"), F.count_if(~F.col("expect_fires") & F.col("fired")).alias("false_alarms"),
    )
    every = results.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    return every.join(per, "detector", "left").fillna(0)


#: How an error type can be reached, and what is true of it today.
ROUTES, STATUSES = ("detector", "rule", "question", "external"), ("covered", "partial", "uncovered")


def coverage(types: DataFrame, rows: DataFrame, findings: DataFrame, detectors: DataFrame) -> DataFrame:
    """kind, name, n: findings of each covered type, types that no row covers, rows aimed at no detector, detectors that no row aims at, findings of unknown types.

    types: error_type. rows: error_type, detector, route, status. findings: error_type, source, amount. detectors: detector.
    """
    cited = findings.groupBy("error_type").agg(F.count("*").alias("n"))
    covered = rows.filter("status <> 'uncovered'").join(cited, "error_type", "left").select(F.lit("covered").alias("kind"), F.col("error_type").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    one = F.lit(1).cast("bigint").alias("n")
    missing = types.join(rows.select("error_type"), "error_type", "left_anti").select(F.lit("type without a row").alias("kind"), F.col("error_type").alias("name"), one)
    nowhere = rows.join(detectors, "detector", "left_anti").select(F.lit("row without a detector").alias("kind"), F.col("error_type").alias("name"), one)
    idle = detectors.join(rows.filter("status <> 'uncovered'").select("detector"), "detector", "left_anti").select(F.lit("detector without a type").alias("kind"), F.col("detector").alias("name"), one)
    unknown = findings.join(types, "error_type", "left_anti").groupBy("error_type").agg(F.count("*").alias("n")).select(F.lit("finding of unknown type").alias("kind"), F.col("error_type").alias("name"), "n")
    return covered.unionByName(missing).unionByName(nowhere).unionByName(idle).unionByName(unknown)


def taxonomy_counts(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """kind, name, n: rows per route and per status (those without any too), and the amount found per error type."""
    spark = rows.sparkSession
    out = None
    for kind, names, column in (("route", ROUTES, "route"), ("status", STATUSES, "status")):
        every = spark.createDataFrame([(kind, x) for x in names], "kind string, name string")
        per = every.join(rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")), "name", "left").select("kind", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        out = per if out is None else out.unionByName(per)
    amounts = findings.groupBy(F.col("error_type").alias("name")).agg(F.sum("amount").cast("bigint").alias("n")).select(F.lit("amount").alias("kind"), "name", "n")
    return out.unionByName(amounts)
