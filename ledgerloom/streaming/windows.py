"""Windows and sessions of event time that close once and for all, with late rows kept and counted.

A micro-batch is parted by the watermark before it (the largest event time of all earlier batches, less the delay): rows whose window has closed go
to the late rows, with the number of the batch; the others join the open windows. Windows that the new watermark passes are written out once
and leave the state, which so holds open windows only. Open windows, closed ones, late rows and the watermark are committed together, by a manifest, and a repeated batch counts once.
Sessions are joined from pieces: rows of a key in one stretch of the gap's length are one piece, so a busy key costs a row per stretch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.manifest import Manifest


class Windows:
    """``folder``; ``opened``: rows to partial windows (with ``end``); ``joined``: partial windows to whole ones; ``delay`` in seconds.

    ``reach``: seconds behind a window's end from which a row that isn't late can still join it; it closes once the watermark is as far beyond its end.
    ``event`` is the column of event time. The state's schema is that of ``joined(opened(rows))``.
    """

    def __init__(self, spark: SparkSession, folder: str, opened: Callable[[DataFrame], DataFrame], joined: Callable[[DataFrame], DataFrame], ends: Column, delay: int, event: str = "ts", reach: int = 0):
        self.spark, self.opened, self.joined, self.ends, self.delay, self.event, self.reach = spark, opened, joined, ends, delay, event, reach
        self.manifest = Manifest(spark, folder)

    def _read(self, paths: list[str], like: DataFrame) -> DataFrame:
        full = [f"{self.manifest.folder}/{p}" for p in paths]
        return self.spark.read.schema(like.schema).parquet(*full) if full else self.spark.createDataFrame([], like.schema)

    def _write(self, rows: DataFrame, kind: str) -> str:
        path = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.manifest.folder}/{path}")
        return path

    def add(self, batch: DataFrame, number: int) -> None:
        version, was = self.manifest.newest()
        if was.get("batch", -1) >= number:
            return
        mark = was.get("mark")
        at = F.lit(None if mark is None else mark - self.delay * 1_000_000).cast("long")
        late = F.coalesce(F.unix_micros(self.ends) <= at, F.lit(False))
        paths = {k: list(was.get("paths", {}).get(k, [])) for k in ("open", "closed", "late")}
        whole = self.joined(self._read(paths["open"], self.joined(self.opened(batch))).unionByName(self.opened(batch.filter(~late))))
        laid = self._write(whole, "open")  # written once: what closes and what stays are read from there
        whole = self._read([laid], whole)
        newest = batch.agg(F.max(F.unix_micros(self.event)).alias("m")).first()["m"]
        mark = newest if mark is None else mark if newest is None else max(mark, newest)
        passed = F.unix_micros("end") <= F.lit(None if mark is None else mark - (self.delay + self.reach) * 1_000_000).cast("long")
        passed = F.coalesce(passed, F.lit(False))
        paths["closed"].append(self._write(whole.filter(passed), "closed"))
        paths["open"] = [self._write(whole.filter(~passed), "open")]
        paths["late"].append(self._write(batch.filter(late).withColumn("batch", F.lit(number).cast("long")), "late"))
        self.manifest.commit(version + 1, {"batch": number, "mark": mark, "paths": paths})
        self.manifest.drop(laid)
        self.manifest.tidy(("open",))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rows(self, kind: str) -> DataFrame:
        """``open``, ``closed`` or ``late`` rows now; none before the first batch."""
        paths = self.manifest.newest()[1].get("paths", {}).get(kind, [])
        if not paths:
            return self.spark.createDataFrame([], "none string")
        return self.spark.read.parquet(*[f"{self.manifest.folder}/{p}" for p in paths])


def _seconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.removesuffix("s")]


def metrics(spark: SparkSession, folder: str, late: str = "10 minutes", size: str = "1 hour") -> Windows:
    """Rows, writes and unknown outcomes per company and window of event time: company_key, start, end, rows, writes, unknown."""
    window = F.window("ts", size)
    keys, names = ["company_key", "start", "end"], ("rows", "writes", "unknown")

    def opened(log: DataFrame) -> DataFrame:
        own = log.groupBy("company_key", window.alias("w")).agg(F.count("*").alias("rows"), F.count_if(F.col("action") == "write_attempted").alias("writes"), F.count_if(F.col("outcome") == "unknown").alias("unknown"))
        return own.select("company_key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *names)

    def joined(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])

    return Windows(spark, folder, opened, joined, window["end"], _seconds(late))


def sessions(spark: SparkSession, folder: str, gap: str = "30 minutes", late: str = "10 minutes") -> Windows:
    """Lines of one operation that follow each other within ``gap``: operation_id, first, last, end (last and the gap), lines.

    A line is late a gap after its own time; until then it can come behind a session's last line by less than a gap, so a session closes a gap after its end.
    """
    wide = _seconds(gap)
    length = F.make_interval(secs=F.lit(wide))

    def opened(log: DataFrame) -> DataFrame:
        stretch = F.floor(F.unix_micros("ts") / (wide * 1_000_000)).alias("stretch")
        own = log.groupBy("operation_id", stretch).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("lines"))
        return own.select("operation_id", "first", "last", (F.col("last") + length).alias("end"), "lines")

    def joined(parts: DataFrame) -> DataFrame:
        order = W.partitionBy("operation_id").orderBy("first", "last")
        so_far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
        own = parts.withColumn("fresh", F.coalesce(F.col("first") >= so_far, F.lit(True)).cast("int"))
        own = own.withColumn("nth", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
        own = own.groupBy("operation_id", "nth").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("lines").alias("lines"))
        return own.select("operation_id", "first", "last", (F.col("last") + length).alias("end"), "lines")

    return Windows(spark, folder, opened, joined, F.col("ts") + length, _seconds(late), reach=wide)
