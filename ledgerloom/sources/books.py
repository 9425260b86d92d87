"""Voucher exports in XML, operation logs in JSON lines, and the sinks of books, indexes and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import operation_in
from .manifest import Manifest

_VOUCHER = "ID string, DATE string, PARTY string, NARRATION string, LEG array<struct<LEDGER:string,PAISE:bigint>>"
_LOG = "ts timestamp, operation string, company string, ok boolean, ms bigint, detail string"


def day_book(spark: SparkSession, path: str) -> DataFrame:
    """Vouchers of an export with ``shape``: ``kept`` for one debit and one credit (positive and negative legs), else ``skipped``.

    A voucher that has no legs at all, and a skipped one that carries our marker, refuse the load, as the file isn't what it says.
    """
    rows = spark.read.format("xml").option("rowTag", "VOUCHER").schema(_VOUCHER).load(path)
    legs = F.coalesce("LEG", F.array().cast("array<struct<LEDGER:string,PAISE:bigint>>"))
    debits, credits_ = F.filter(legs, lambda x: x["PAISE"] > 0), F.filter(legs, lambda x: x["PAISE"] < 0)
    plain = (F.size(legs) == 2) & (F.size(debits) == 1) & (F.size(credits_) == 1) & (F.get(debits, F.lit(0))["PAISE"] == -F.get(credits_, F.lit(0))["PAISE"])
    refused = F.when(F.size(legs) == 0, F.raise_error(F.concat(F.lit("a voucher without legs: "), F.coalesce("ID", F.lit("?")))).cast("string"))
    ours = operation_in(F.coalesce("NARRATION", F.lit(""))).isNotNull()
    refused = F.coalesce(refused, F.when(~plain & ours, F.raise_error(F.concat(F.lit("a voucher of ours that can't be read: "), F.coalesce("ID", F.lit("?")))).cast("string")))
    return rows.select(
        F.col("ID").alias("id"), F.to_date("DATE", "yyyyMMdd").alias("date"), F.col("PARTY").alias("party"), F.coalesce("NARRATION", F.lit("")).alias("narration"),
        F.get(debits, F.lit(0))["LEDGER"].alias("debit_account"), F.get(credits_, F.lit(0))["LEDGER"].alias("credit_account"), F.get(debits, F.lit(0))["PAISE"].alias("amount_paise"),
        F.coalesce(refused, F.when(plain, "kept").otherwise("skipped")).alias("shape"),
    )


def operations(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Log lines, half-written ones left out; the newest ``last``, oldest of them first."""
    rows = spark.read.schema(_LOG).option("mode", "DROPMALFORMED").json(path)
    return rows if last is None else rows.orderBy(F.desc("ts")).limit(last).orderBy("ts")


def write_book(vouchers: DataFrame, truth: DataFrame, folder: str, compression: str = "none") -> None:
    """Vouchers and the answer key to two folders of JSON lines, as they are or compressed; every row has every key."""
    for rows, name in ((vouchers, "vouchers"), (truth, "truth")):
        rows.write.mode("error").option("ignoreNullFields", "false").option("compression", compression).json(f"{folder}/{name}")


class Companies:
    """An index by company, each company's rows in folders of their own; a manifest points at the folder that holds.

    Rows are written to a new folder first; then one commit moves the pointer. So a reader has a company as it was or as it is, and of a replaced company
    never both or neither. Old folders stay while the manifest before the newest names them, for readers that have just begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema, self.manifest = spark, schema, Manifest(spark, path)

    def _point(self, change) -> None:
        """``change``: the pointers to what they become; again if another writer was first, as its companies have to stay."""
        while True:
            number, content = self.manifest.newest()
            if self.manifest.commit(number + 1, {"paths": change(dict(content.get("paths", {})))}):
                self.manifest.tidy(("data",))
                return

    def write(self, index: DataFrame) -> None:
        """Replaces every company that ``index`` has rows of, in one commit; the others stay. A null company is refused."""
        place = f"data/{uuid.uuid4().hex}"
        named = F.coalesce("company_key", F.raise_error(F.lit("rows without a company")).cast("string"))
        index.withColumn("folder", F.sha2(named, 256)).write.partitionBy("folder").parquet(f"{self.manifest.folder}/{place}")
        fresh = {r["company_key"]: f"{place}/folder={r['folder']}" for r in index.select("company_key").distinct().withColumn("folder", F.sha2("company_key", 256)).collect()}  # a row per company
        self._point(lambda old: old | fresh)

    def replace(self, index: DataFrame, company: str) -> None:
        """One company's rows; rows of another company refuse the write, and no rows at all leave the company empty."""
        if not index.filter(~F.col("company_key").eqNullSafe(F.lit(company))).isEmpty():
            raise ValueError(f"rows of another company than {company}")
        place = f"data/{uuid.uuid4().hex}"
        index.write.parquet(f"{self.manifest.folder}/{place}")
        self._point(lambda old: old | {company: place})

    def forget(self, company: str) -> None:
        """The company's pointer goes; one that isn't there is no error. Its rows go too, with every manifest that names them."""
        self._point(lambda old: {k: v for k, v in old.items() if k != company})
        self.manifest.tidy(("data",), keep=1)

    def read(self, companies: list[str] | None = None) -> DataFrame:
        """The rows of all companies, or of those named; of what one manifest says."""
        paths = self.manifest.newest()[1].get("paths", {})
        full = [f"{self.manifest.folder}/{p}" for c, p in sorted(paths.items()) if companies is None or c in companies]
        return self.spark.read.schema(self.schema).parquet(*full) if full else self.spark.createDataFrame([], self.schema)


def append_actions(log: DataFrame, path: str, nullable: tuple[str, ...] = ("actor", "previous_state"), mark: str = "not recorded") -> None:
    """Append only; the mark for what wasn't recorded is stored as null."""
    log.withColumns({c: F.nullif(F.col(c), F.lit(mark)) for c in nullable if c in log.columns}).write.mode("append").parquet(path)


def actions(spark: SparkSession, path: str, nullable: tuple[str, ...] = ("actor", "previous_state"), mark: str = "not recorded") -> DataFrame:
    log = spark.read.parquet(path)
    return log.withColumns({c: F.coalesce(c, F.lit(mark)) for c in nullable if c in log.columns}).orderBy("seq")
