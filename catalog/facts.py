"""Fact tables derived from the given tables, in Spark and as SQL for the oracle.

The given tables are random, so an incident, gaps and odd values are planted by
rules on keys and dates. Every fact keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.operators.cohorts import tag_from

ORDERS_CUTOFF = "1999-01-01"
SHIPMENTS_CUTOFF = "1999-01-01"
EVENTS_CUTOFF = "2024-01-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(day: str):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def orders_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a price cut for status F from the cutoff on."""
    late_f = (F.col("o_orderdate") >= _stamp(ORDERS_CUTOFF)) & (F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") * F.when(late_f, 0.7).otherwise(1.0)).alias("amount"),
    )


def orders_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_from(orders_plain(spark, sf_dir), "ts", _stamp(ORDERS_CUTOFF))


ORDERS_SQL = f"""
fact AS (
  SELECT o_orderkey AS row_id, o_orderdate AS ts, o_orderstatus AS status, o_orderpriority AS priority,
    o_totalprice * CASE WHEN o_orderdate >= TIMESTAMP '{ORDERS_CUTOFF}' AND o_orderstatus = 'F'
      THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS amount,
    CASE WHEN o_orderdate >= TIMESTAMP '{ORDERS_CUTOFF}' THEN 'anomaly'
      WHEN o_orderdate < TIMESTAMP '{ORDERS_CUTOFF}' THEN 'baseline' END AS period
  FROM orders)"""


def shipments_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a revenue drop in one crossed cohort, which also grows, and a drifting discount."""
    late = F.col("l_shipdate") >= _stamp(SHIPMENTS_CUTOFF)
    broken = late & (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.when(late & (F.col("l_linestatus") == "F") & (q > 40), "R").otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("line_status"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * F.when(broken, 0.55).otherwise(1.0)).alias("revenue"),
        (F.col("l_discount") + F.when(late, 0.04).otherwise(0.0)).alias("discount"),
        F.col("l_tax").alias("tax"),
        q.alias("quantity"),
        (q * q * q * q * q * q / 1000000.0).alias("handling"),
    )
    return tag_from(rows, "ts", _stamp(SHIPMENTS_CUTOFF))


SHIPMENTS_DIMS = ["flag", "line_status"]
SHIPMENTS_COVARIATES = ["discount", "tax", "quantity", "handling"]
BATCH_METRICS = ["revenue", "quantity", "discount"]
BATCH_CUTOFFS = [SHIPMENTS_CUTOFF, "1996-01-01"]
SHIPMENTS_SQL = f"""
fact AS (
  SELECT l_shipdate AS ts, CASE WHEN l_shipdate >= TIMESTAMP '{SHIPMENTS_CUTOFF}' AND l_linestatus = 'F' AND l_quantity > 40
      THEN 'R' ELSE l_returnflag END AS flag, l_linestatus AS line_status,
    l_extendedprice * (1.0::DOUBLE - l_discount)
      * CASE WHEN l_shipdate >= TIMESTAMP '{SHIPMENTS_CUTOFF}' AND l_returnflag = 'R' AND l_linestatus = 'F'
        THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END AS revenue,
    l_discount + CASE WHEN l_shipdate >= TIMESTAMP '{SHIPMENTS_CUTOFF}' THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS discount,
    l_tax AS tax, l_quantity AS quantity,
    l_quantity * l_quantity * l_quantity * l_quantity * l_quantity * l_quantity / 1000000.0::DOUBLE AS handling,
    CASE WHEN l_shipdate >= TIMESTAMP '{SHIPMENTS_CUTOFF}' THEN 'anomaly'
      WHEN l_shipdate < TIMESTAMP '{SHIPMENTS_CUTOFF}' THEN 'baseline' END AS period
  FROM lineitem)"""


def events_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a late spike of errors, missing values and missing regions."""
    late_error = (F.col("ts") >= _stamp(EVENTS_CUTOFF)) & (F.col("event_type") == "error")
    spiked = F.col("value") * F.when(late_error, 3.0).otherwise(1.0)
    region = F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        "ts",
        "event_type",
        F.when(F.col("event_id") % 23 != 0, region).alias("region"),
        F.when(F.col("event_id") % 17 != 0, spiked).alias("value"),
    )


def events_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_from(events_plain(spark, sf_dir), "ts", _stamp(EVENTS_CUTOFF))


EVENTS_DIMS = ["event_type", "region"]
EVENTS_SQL = f"""
fact AS (
  SELECT event_id AS row_id, ts, event_type,
    CASE WHEN event_id % 23 <> 0 THEN 'R' || (user_id % 4)::VARCHAR END AS region,
    CASE WHEN event_id % 17 <> 0 THEN value * CASE WHEN ts >= TIMESTAMP '{EVENTS_CUTOFF}' AND event_type = 'error'
      THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END END AS value,
    CASE WHEN ts >= TIMESTAMP '{EVENTS_CUTOFF}' THEN 'anomaly'
      WHEN ts < TIMESTAMP '{EVENTS_CUTOFF}' THEN 'baseline' END AS period
  FROM events)"""


def quality_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary metric: document labels, long documents against short ones."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return tag_from(rows, "n_chars", F.lit(2000)).select("doc_id", "lang", "source", "quality", "toxic", "period")


QUALITY_SQL = """
fact AS (
  SELECT l.doc_id, d.lang, d.source, l.quality, l.toxic,
    CASE WHEN d.n_chars >= 2000 THEN 'anomaly' WHEN d.n_chars < 2000 THEN 'baseline' END AS period
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def step_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with flat days and one clear step down; every day carries a small ripple."""
    day = F.to_date("o_orderdate")
    level = F.when(day >= F.lit("2000-03-01").cast("date"), 20.0).otherwise(100.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("status"),
        (level + (F.dayofyear(day) % 7) * 0.5).alias("level"),
    )


STEP_SQL = """
fact AS (
  SELECT o_orderkey AS row_id, o_orderdate AS ts, o_orderstatus AS status,
    CASE WHEN o_orderdate::DATE >= DATE '2000-03-01' THEN 20.0::DOUBLE ELSE 100.0::DOUBLE END
      + (dayofyear(o_orderdate) % 7) * 0.5::DOUBLE AS level
  FROM orders)"""


def mixed_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one column for each profiling rule."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(key % 17 != 0, F.col("o_totalprice") * F.when(key % 101 == 0, 10.0).otherwise(1.0)).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_text"),
        F.col("o_orderpriority").alias("day_label"),
        F.when(key % 3 == 0, "1").when(key % 3 == 1, "0").alias("won"),
        F.lit("x").alias("constant"),
        F.lit(None).cast("string").alias("empty"),
    )


MIXED_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    "urgent", "created_text", "day_label", "won", "constant", "empty",
]
MIXED_SQL = """
fact AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice * CASE WHEN o_orderkey % 101 = 0
      THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END END AS o_totalprice,
    o_orderdate, o_orderpriority,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent,
    strftime(o_orderdate, '%Y-%m-%d') AS created_text,
    o_orderpriority AS day_label,
    CASE WHEN o_orderkey % 3 = 0 THEN '1' WHEN o_orderkey % 3 = 1 THEN '0' END AS won,
    'x' AS constant, NULL::VARCHAR AS empty
  FROM orders)"""
