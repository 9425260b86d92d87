"""Choosing detectors' settings on one half of the companies, and measuring them on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .detect import with_ceiling
from .evaluate import MOST_ALARMS
from .history import lookup, vendor_index, with_vendor

#: The settings of each detector, most sensitive first; those without a setting have one point.
GRID = (("vendor_switch", (1, 2, 3, 4, 5)), ("first_use", (0,)), ("magnitude", (100, 150, 200, 300, 500, 1000, 1500)), ("gst_anomaly", (0,)))


def fired(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Entries with, per detector, how many of its settings fire (settings are ordered, so a number says which): one pass for the whole grid."""
    grid = dict(GRID)
    seen = lookup(with_vendor(entries), vendor_index(history).drop("raw"), ["stem", "form", "vendor_key"])
    elsewhere = (F.col("status") == "match") & (F.get("accounts", F.lit(0)) != F.col("debit_account"))
    level = F.size(F.filter(F.array(*map(F.lit, grid["vendor_switch"])), lambda n: n <= F.col("most")))
    rows = seen.withColumn("vendor_switch", F.when(elsewhere, level).otherwise(0)).drop("accounts", "most", "status", "stem", "form", "vendor_key")
    rows = with_ceiling(rows, history)
    level = F.size(F.filter(F.array(*map(F.lit, grid["magnitude"])), lambda p: F.col("amount_paise") * 100 > F.col("high") * p))
    rows = rows.withColumn("magnitude", F.when(F.col("seen") >= 2, level).otherwise(0)).drop("seen", "high")
    per = history.groupBy("company_key", "debit_account").agg(F.max(F.coalesce("gst_paise", F.lit(0))).alias("__most"))
    rows = rows.join(per, ["company_key", "debit_account"], "left")
    rows = rows.withColumn("first_use", F.col("__most").isNull().cast("int"))
    return rows.withColumn("gst_anomaly", ((F.coalesce("gst_paise", F.lit(0)) != 0) & F.coalesce(F.col("__most") == 0, F.lit(False))).cast("int")).drop("__most")


def counts(rows: DataFrame) -> DataFrame:
    """Clean entries per half and combination of levels: a few hundred rows at any size of input."""
    names = rows.select("company_key").distinct()
    half = F.when(F.row_number().over(W.orderBy("company_key")) % 2 == 1, "calibration").otherwise("held_out")
    return rows.join(names.select("company_key", half.alias("half")), "company_key").groupBy("half", *[d for d, _ in GRID]).agg(F.count("*").alias("n"))


def calibrate(rows: DataFrame, target: int = MOST_ALARMS) -> list[dict]:
    """Detector by detector, the most sensitive setting whose union with those kept stays inside the target on the calibration half.

    ``rows``: clean entries from ``fired``. The held-out half is measured once the settings are fixed. A detector that no setting
    brings inside is left out and shown at its most conservative one.
    """
    table = [r.asDict() for r in counts(rows).collect()]

    def measured(half: str, settings: dict[str, int]) -> tuple[int, int]:
        own = [r for r in table if r["half"] == half]
        return sum(r["n"] for r in own if any(r[d] > k for d, k in settings.items())), sum(r["n"] for r in own)

    kept: dict[str, int] = {}
    out = []
    for detector, grid in GRID:
        chosen = None
        for k in range(len(grid)):
            flagged, clean = measured("calibration", kept | {detector: k})
            if clean and flagged * 100 <= target * clean:
                chosen = k
                break
        k = len(grid) - 1 if chosen is None else chosen
        if chosen is not None:
            kept[detector] = chosen
        a, b = measured("calibration", {detector: k}), measured("held_out", {detector: k})
        out.append({"detector": detector, "setting": grid[k], "kept": chosen is not None, "flagged": a[0], "clean": a[1], "held_flagged": b[0], "held_clean": b[1]})
    return out
