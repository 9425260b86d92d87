"""Queries on guarded reading, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import extraction as X
from . import views as V

FIELDS = ("supplier", "number", "date", "total")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of bytes. By key: some are torn, some state a total that is no number, some no date; some are copies of another, and some have nothing in them."""
    o, k = V.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    same = F.when(k % 11 == 10, k - k % 11).otherwise(k)  # what its bytes say: the key of the bill printed
    total = F.when(same % 7 == 3, F.concat(F.lit("x"), same.cast("string"))).otherwise((same * 100).cast("string"))
    record = F.struct(F.concat(F.lit("Supplier "), (same % 23).cast("string")).alias("supplier"), (same % 500).cast("string").alias("number"), F.when(same % 5 != 2, F.lit("2024-01-31")).alias("date"), total.alias("total"), same.alias("key"))
    text = F.to_json(record)
    text = F.when(same % 13 == 5, F.concat(F.lit("!"), text)).otherwise(text)
    data = F.when(k % 17 != 9, F.encode(text, "UTF-8"))
    return o.select(F.concat(F.lit("bill-"), k.cast("string")).alias("name"), k.alias("seq"), data.alias("data"), F.lit("application/json").alias("mime"))


def read_record(data: bytes | None, mime: str | None) -> dict:
    """A bill's record: fields as stated, the total as a whole number of minor units."""
    if data is None:
        raise ValueError("the document holds no bytes")
    if not data.startswith(b"{"):
        raise ValueError(f"the record starts with {data[:1].decode()}")
    said = json.loads(data)
    return {"supplier": said["supplier"], "number": said["number"], "date": said.get("date"), "total": int(said["total"])}


def _outcome(spark: SparkSession, sf_dir: str) -> X.Outcome:
    return X.guarded(_documents(spark, sf_dir), X.by_row(read_record), FIELDS, "records")


def ext_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's output and what it says there: its total, its failure, or the document it repeats; and the source of its date."""
    read, broken, repeats = _outcome(spark, sf_dir)
    rows = read.select("name", F.lit("read").alias("output"), F.col("fields")["total"].alias("detail"), F.col("sources")["date"].alias("date_from"))
    rows = rows.unionByName(broken.select("name", F.lit("broken").alias("output"), F.col("failure").alias("detail"), F.col("sources")["date"].alias("date_from")))
    return rows.unionByName(repeats.select("name", F.lit("repeats").alias("output"), F.col("first_seen_as").alias("detail"), F.lit(None).cast("string").alias("date_from")))


_MADE = """
WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 10 THEN o_orderkey - o_orderkey % 11 ELSE o_orderkey END AS s, o_orderkey % 17 = 9 AS hollow FROM orders),
f AS (SELECT s, min(k) AS first FROM d WHERE NOT hollow GROUP BY s),
o AS (SELECT d.k, d.s, 'bill-' || d.k AS name, CASE WHEN NOT hollow AND d.k <> f.first THEN 'repeats' WHEN hollow OR d.s % 13 = 5 OR d.s % 7 = 3 THEN 'broken' ELSE 'read' END AS output,
  CASE WHEN hollow THEN 'ValueError: the document holds no bytes' WHEN d.s % 13 = 5 THEN 'ValueError: the record starts with !' WHEN d.s % 7 = 3 THEN 'ValueError: invalid literal for int() with base 10: ''x' || d.s || '''' END AS failure, f.first FROM d LEFT JOIN f USING (s))"""
register("ext_guarded", ext_guarded, _MADE + """
SELECT name, output, CASE output WHEN 'read' THEN CAST(s * 100 AS VARCHAR) WHEN 'broken' THEN failure ELSE 'bill-' || first END AS detail,
  CASE output WHEN 'read' THEN CASE WHEN s % 5 = 2 THEN 'not found: records gave no value for it' ELSE 'records' END WHEN 'broken' THEN 'not found: ' || failure END AS date_from FROM o""")
register("agg_guarded", lambda s, d: X.counted(_outcome(s, d)), _MADE + " SELECT n.output, count(o.output) AS n FROM (VALUES ('read'), ('broken'), ('repeats')) n(output) LEFT JOIN o USING (output) GROUP BY 1")
register("ext_same_bills", lambda s, d: X.same_bills(_outcome(s, d).read).filter("same_as IS NOT NULL").select("name", "same_as"), _MADE + """
, r AS (SELECT name, first_value(name) OVER (PARTITION BY s % 23, s % 500 ORDER BY k) AS same_as FROM o WHERE output = 'read') SELECT * FROM r WHERE name <> same_as""")
