"""The log as a stream: first claims, an index that grows, repeats, vouchers judged as they arrive; windowed metrics and sessions whose state Spark keeps.

Claims and the index have no watermark, as what is claimed stays claimed: their state is a keyed table (``streaming.table``) to which a micro-batch adds a run of its own size.
Windows whose late rows are kept and counted are in ``streaming.windows``; the plain forms here leave late rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import checks as C
from ..operators import decide as D
from ..operators import detect as T
from ..operators import history as H
from .table import Table

CLAIMS = "company_key string, operation_id string, n long, first struct<version:long,seq:long>"
INDEX = "company_key string, vendor_key string, account string, times long, first struct<seq:long,raw:string>"
DOCUMENTS = "hash string, supplier string, number string, n long, first struct<version:long,seq:long,doc:string>"


def claims(spark: SparkSession, folder: str) -> Table:
    """company_key, operation_id, refused, seq."""
    whole = [F.sum("n").alias("n"), F.min("first").alias("first")]
    return Table(spark, folder, CLAIMS, ("company_key", "operation_id"), whole, ("company_key", "operation_id", (F.col("n") - 1).alias("refused"), F.col("first.seq").alias("seq")))


def growing_index(spark: SparkSession, folder: str) -> Table:
    """company_key, vendor_key, account, times, first_seq, raw."""
    whole = [F.sum("times").alias("times"), F.min("first").alias("first")]
    return Table(spark, folder, INDEX, ("company_key", "vendor_key", "account"), whole, ("company_key", "vendor_key", "account", "times", F.col("first.seq").alias("first_seq"), F.col("first.raw").alias("raw")))


def seen_documents(spark: SparkSession, folder: str) -> Table:
    """hash, supplier, number, first, n."""
    whole = [F.sum("n").alias("n"), F.min("first").alias("first")]
    return Table(spark, folder, DOCUMENTS, ("hash", "supplier", "number"), whole, ("hash", "supplier", "number", F.col("first.doc").alias("first"), "n"))


def _adding(stream: DataFrame, table: Table, checkpoint: str, made: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda batch, number: table.add(lambda version: made(batch, version), number, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claim(log: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """The first claim (smallest seq of the first batch that has it) of (company_key, operation_id) holds; ``refused`` counts later ones."""
    return _adding(log, table, checkpoint, lambda b, version: b.select("company_key", "operation_id", F.lit(1).cast("long").alias("n"), F.struct(F.lit(version).cast("long").alias("version"), F.col("seq").cast("long").alias("seq")).alias("first")))


def grow_index(vouchers: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Counts per (company, vendor, account) and the first raw name; equal to the batch index of all that has arrived.

    A batch is summed up by raw name first, so that a name is taken apart once and not for each of its vouchers.
    """

    def made(batch: DataFrame, version: int) -> DataFrame:
        first = F.struct(F.col("seq").cast("long").alias("seq"), F.col("party").alias("raw"))
        per = batch.groupBy("company_key", "party", F.col("debit_account").alias("account")).agg(F.count("*").alias("times"), F.min(first).alias("first"))
        return per.select("company_key", X.vendor_key(F.col("party")).alias("vendor_key"), "account", "times", "first").filter("vendor_key <> '' AND account <> ''")

    return _adding(vouchers, table, checkpoint, made)


def remember_documents(docs: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """What was seen, across runs: per text its first document and number; and the same per (supplier, number) of bills that state both.

    docs: doc_id (as text), seq, text, supplier, number. ``first`` is the document with the smallest seq of the first batch that has the key.
    """

    def made(batch: DataFrame, version: int) -> DataFrame:
        none = F.lit("")
        bill = F.col("supplier").isNotNull() & F.col("number").isNotNull()
        keys = F.array_compact(F.array(F.struct(F.sha2("text", 256).alias("hash"), none.alias("supplier"), none.alias("number")), F.when(bill, F.struct(none.alias("hash"), F.col("supplier"), F.col("number")))))
        first = F.struct(F.lit(version).cast("long").alias("version"), F.col("seq").cast("long").alias("seq"), F.col("doc_id").alias("doc"))
        return batch.filter("text IS NOT NULL").select(first.alias("first"), F.lit(1).cast("long").alias("n"), F.inline(keys))

    return _adding(docs, table, checkpoint, made)


def metrics(log: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows, writes and unknown outcomes per company and window of event time; rows later than the watermark are dropped."""
    own = log.withWatermark("ts", late).groupBy("company_key", F.window("ts", size, slide) if slide else F.window("ts", size))
    return own.agg(F.count("*").alias("rows"), F.count_if(F.col("action") == "write_attempted").alias("writes"), F.count_if(F.col("outcome") == "unknown").alias("unknown"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines of one operation that follow each other within ``gap``: their number and the time between first and last."""
    own = log.withWatermark("ts", late).groupBy("operation_id", F.session_window("ts", gap))
    return own.agg(F.count("*").alias("lines"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def distinct_documents(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents whose bytes weren't seen within the watermark; bounded state, so weaker than ``claim`` on the hash."""
    return docs.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def facts(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What arriving vouchers are judged by, as tables: per vendor its accounts, most and status; per account account_n, account_tax, seen and high."""
    vendors = H.ranked(H.vendor_index(history), ["stem", "form", "vendor_key"])
    accounts = history.groupBy("company_key", "debit_account").agg(F.count("*").alias("account_n"), F.max(F.coalesce("gst_paise", F.lit(0))).alias("account_tax"), F.max("amount_paise").alias("high")).withColumn("seen", F.col("account_n"))
    return vendors, accounts


def judged(entries: DataFrame, vendors: DataFrame, accounts: DataFrame, chart: DataFrame) -> DataFrame:
    """company_key, id, outcome, first, n: vouchers through look-up, detectors, checks and decision as they arrive (joins of a stream with tables)."""
    rows = H.with_vendor(entries).join(vendors, ["company_key", "stem", "form", "vendor_key"], "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit(H.NO_MATCH))).withColumn("accounts", F.coalesce("accounts", F.array().cast("array<string>")))
    rows = rows.join(accounts, ["company_key", "debit_account"], "left")
    names = tuple(n for n in T.BUILT_IN if n not in T.WITHDRAWN)
    return D.outcomes(D.with_problems(C.checked(T.flagged(rows, names), chart)))
