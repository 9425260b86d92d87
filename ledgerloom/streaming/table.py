"""A keyed table that grows by small sorted runs: a micro-batch writes what it brings and nothing else.

A key's value is the aggregate of all its rows, by functions that don't mind in which order or grouping they are applied (sums, least, greatest,
least by something), so a batch is added without reading what is there. Runs of like size are merged once there are FAN of them, so a row is rewritten
as often as the table's size has powers of FAN, and a reader has at most FAN runs of each size. A merged run has as many files as its size asks for. Which runs
are alive is said by a manifest; it also says which batches of which writer are in, so a batch that is repeated after a failure counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifest

#: Runs of like size that are merged; bytes up to which runs are the smallest size; bytes of a file, or so.
FAN, SMALL, FILE = 4, 4 << 20, 128 << 20


class Table:
    """``folder``; ``schema`` of the rows; ``keys``; ``whole``: the aggregates, named as the columns; ``shown``: what ``read`` selects."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], whole: Sequence[Column], shown: Sequence[Column | str] = ("*",), fan: int = FAN):
        self.spark, self.schema, self.keys, self.whole, self.shown, self.fan = spark, schema, list(keys), list(whole), list(shown), fan
        self.manifest = Manifest(spark, folder)

    def _rows(self, runs: Sequence[dict]) -> DataFrame:
        paths = [f"{self.manifest.folder}/{r['path']}" for r in runs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _aggregated(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*self.whole)

    def _write(self, rows: DataFrame, level: int) -> dict:
        path = f"runs/{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*self.keys).write.parquet(f"{self.manifest.folder}/{path}")
        return {"path": path, "bytes": self.manifest.size(path), "level": level}

    def read(self, version: int | None = None) -> DataFrame:
        """The table now, or as it was at a version that is still kept."""
        content = self.manifest.newest()[1] if version is None else self.manifest.at(version)
        return self._aggregated(self._rows(content.get("runs", []))).select(*self.shown)

    def add(self, made: Callable[[int], DataFrame], batch: int, writer: str) -> None:
        """The rows of one micro-batch, once. ``made`` gets the version that they will be in, as older versions may win."""
        while True:
            number, content = self.manifest.newest()
            done, runs = dict(content.get("done", {})), list(content.get("runs", []))
            if done.get(writer, -1) >= batch:
                return
            was = {r["path"] for r in runs}
            own = self._write(self._aggregated(made(number + 1)), 0)
            made_here = [own["path"]]
            runs = self._merged([*runs, own], made_here)
            alive = {r["path"] for r in runs}
            won = self.manifest.commit(number + 1, {"done": done | {writer: batch}, "runs": runs, "paths": sorted(alive)})
            for path in made_here:
                if not won or path not in alive | was:  # another writer was first, or merged away already
                    self.manifest.drop(path)
            if won:
                self.manifest.tidy(("runs",))
                return

    def _merged(self, runs: list[dict], made_here: list[str]) -> list[dict]:
        level = 0
        while level <= max(r["level"] for r in runs):
            same = [r for r in runs if r["level"] == level]
            if len(same) >= self.fan:
                total = sum(r["bytes"] for r in same)
                rows = self._aggregated(self._rows(same)).repartition(max(1, -(-total // FILE)), *self.keys)
                up = level + 1 if total > SMALL * self.fan**level else level
                merged = self._write(rows, up)
                made_here.append(merged["path"])
                runs = [r for r in runs if r["level"] != level] + [merged]
            level += 1
        return runs
