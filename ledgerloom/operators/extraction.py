"""Reading documents with readers that may fail: no row is lost, none is read twice, and every field has a value or a reason.

A reader is a function of a DataFrame: documents (name, seq, data, mime, hash) in, answers out: name, ``fields`` (map of field to value) and
``failure`` (null, or ``type: message``). ``by_row`` makes one of a plain function and keeps a document's failure to that document. Whatever a reader does, the
three outputs of ``guarded`` add up to its input: a document that gets no answer, several, or one without its fields is broken, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept

Reader = Callable[[DataFrame], DataFrame]
#: Fixed value: what stands for a field that a reader didn't find, before the reason.
NOT_FOUND = "not found"
#: Rows among which the copies of one document are dealt when they are joined to its first sighting.
SALT = 16
ANSWER = "name string, fields map<string,string>, failure string"


class Outcome(NamedTuple):
    """read: name, seq, hash, fields, sources, complete. broken: name, seq, hash, failure, sources. repeats: name, seq, hash, first_seen_as."""

    read: DataFrame
    broken: DataFrame
    repeats: DataFrame


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}" if str(e) else f"{type(e).__name__}: no message"


def _answered(docs: Iterator[pa.RecordBatch], function: Callable[[bytes | None, str | None], Mapping[str, object]]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    for batch in docs:
        fields, failures = [], []
        for data, mime in zip(batch.column("data").to_pylist(), batch.column("mime").to_pylist(), strict=True):
            answer, failure = None, None
            try:
                answer = function(data, mime)
                if not isinstance(answer, Mapping):
                    raise TypeError(f"the reader answered with a {type(answer).__name__} instead of fields")
                answer = [(str(k), None if v is None else str(v)) for k, v in answer.items()]
            except Exception as e:  # one document's failure; an interrupt ends the run  # noqa: BLE001
                answer, failure = None, _told(e)
            fields.append(answer)
            failures.append(failure)
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(fields, kind), pa.array(failures, pa.string())], ["name", "fields", "failure"])


def by_row(function: Callable[[bytes | None, str | None], Mapping[str, object]]) -> Reader:
    """A reader that calls ``function(data, mime)`` for each document, inside tasks; what it raises is that document's failure."""

    def read(docs: DataFrame) -> DataFrame:
        return docs.select("name", "data", "mime").mapInArrow(partial(_answered, function=function), ANSWER)

    return read


def unavailable(reason: str) -> Reader:
    """A reader for when there is none: every document fails for the reason."""
    return lambda docs: docs.select("name", F.lit(None).cast("map<string,string>").alias("fields"), F.lit(reason).alias("failure"))


def sighted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (name, seq, data, mime) parted: the first of each content, by seq and then name, with ``hash``; and the others: name, seq, hash, first_seen_as.

    Null data is a content of its own: it can't be told whether two such documents are one, so each stands for itself. Copies are joined to their first one
    in SALT rows, so that a document that a third of all rows repeat is no one task's work.
    """
    own = docs.select("name", "seq", "data", "mime", F.sha2("data", 256).alias("hash"))
    slim = own.select("name", "seq", "hash").filter("hash IS NOT NULL")
    many = slim.groupBy("hash").agg(F.min(F.struct("seq", "name")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    many = many.select(F.col("hash").alias("__hash"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    dealt = own.withColumn("__dealt", F.pmod(F.xxhash64("seq", "name"), F.lit(SALT)).cast("int"))
    both = dealt.join(many, (F.col("hash") == F.col("__hash")) & (F.col("__dealt") == F.col("__salt")), "left")
    again = F.col("first").isNotNull() & (F.struct("seq", "name") != F.col("first"))
    return both.filter(~again).select("name", "seq", "data", "mime", "hash"), both.filter(again).select("name", "seq", "hash", F.col("first")["name"].alias("first_seen_as"))


def _sources(fields: Sequence[str], reader: str, why: Column, values: Column | None = None) -> Column:
    """Field to where its value is from, or to why there is none: never blank."""
    lost = F.concat(F.lit(f"{NOT_FOUND}: "), why)
    of = lambda f: lost if values is None else F.when(F.trim(values[f]) != "", F.lit(reader)).otherwise(F.lit(f"{NOT_FOUND}: {reader} gave no value for it"))
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(of, fields)))


def guarded(docs: DataFrame, reader: Reader, fields: Sequence[str], name: str = "reader") -> Outcome:
    """``docs`` (name, seq, data, mime; names are unique) through a reader, in three outputs that add up to them.

    Only the first of equal documents is read; the others name it. Of what was read, each of ``fields`` has a value (no blank
    one) or the reason why not, and the source says which; other fields that the reader gave are kept. Where a whole answer
    is missing, every field says why. A reader that fails as a whole, before any row, fails the run.
    """
    first, repeats = sighted(docs)
    answers = reader(first).select(F.col("name").alias("__name"), "fields", "failure")
    per = answers.groupBy("__name").agg(F.count("*").alias("n"), F.min_by(F.struct("fields", "failure"), F.coalesce("failure", F.lit(""))).alias("answer"))
    both = first.select("name", "seq", "hash").join(per, F.col("name") == F.col("__name"), "left")
    got, failed = F.col("answer")["fields"], F.col("answer")["failure"]
    failure = (
        F.when(F.col("n").isNull(), F.lit(f"MissingAnswer: {name} gave no answer"))
        .when(F.col("n") > 1, F.concat(F.lit(f"ManyAnswers: {name} gave "), F.col("n").cast("string"), F.lit(" answers")))
        .when(failed.isNotNull(), F.when(F.trim(failed) == "", F.lit(f"Unexplained: {name} failed without a reason")).otherwise(failed))
        .when(got.isNull(), F.lit(f"MalformedAnswer: {name} gave neither fields nor a failure"))
    )
    both = kept(both.withColumn("failure", failure))  # documents are read once, for both outputs
    said = F.map_filter(got, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    read = both.filter("failure IS NULL").select("name", "seq", "hash", said.alias("fields"), _sources(fields, name, F.lit(""), got).alias("sources"))
    read = read.withColumn("complete", F.size(F.array_except(F.array(*map(F.lit, fields)), F.map_keys("fields"))) == 0)
    broken = both.filter("failure IS NOT NULL").select("name", "seq", "hash", "failure", _sources(fields, name, F.col("failure")).alias("sources"))
    return Outcome(read, broken, repeats)


def same_bills(read: DataFrame, supplier: str = "supplier", number: str = "number") -> DataFrame:
    """``read`` and ``same_as``: the first document, by seq, that states the same supplier and number (folded); null for itself, and where either isn't stated.

    Broken documents and repeats have no say: only bills that were read count. The first of each bill is aggregated before it is joined, and only
    bills stated more than once are, in SALT rows each.
    """
    key = F.when(F.col("fields")[supplier].isNotNull() & F.col("fields")[number].isNotNull(), F.concat_ws("\x1f", F.lower(F.trim(F.col("fields")[supplier])), F.lower(F.trim(F.col("fields")[number]))))
    own = read.withColumn("__bill", key).withColumn("__dealt", F.pmod(F.xxhash64("seq", "name"), F.lit(SALT)).cast("int"))
    many = own.filter("__bill IS NOT NULL").groupBy("__bill").agg(F.min(F.struct("seq", "name")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    many = many.select(F.col("__bill").alias("__of"), F.col("first")["name"].alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    both = own.join(many, (F.col("__bill") == F.col("__of")) & (F.col("__dealt") == F.col("__salt")), "left")
    return both.select(*read.columns, F.when(F.col("first") != F.col("name"), F.col("first")).alias("same_as"))


def counted(outcome: Outcome) -> DataFrame:
    """output, n: how many rows each output has, all three even if empty."""
    rows = [d.select(F.lit(k).alias("output")) for k, d in outcome._asdict().items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("output").agg(F.count("*").alias("n"))
    names = outcome.read.sparkSession.createDataFrame([(k,) for k in outcome._fields], "output string")
    return names.join(every, "output", "left").select("output", F.coalesce("n", F.lit(0)).alias("n"))
