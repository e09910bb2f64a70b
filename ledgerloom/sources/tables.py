"""Readers for the driver tables and the fixture views built on them.

The views re-express the reference's input schemas over the given parquet
tables (see FIXTURES.md):

* ``transactions_from_events`` (TXE): one row per event.
* ``transactions_from_lineitem`` (TXR): line items as card activity.
* ``label_rows`` (LAB): label rows, users repeat.
* ``customer_features`` (FEAT): one tabular row per customer.
* ``labelled_documents`` (DOCQ): all documents, with their quality label if any.

Each function only declares a plan; column pruning and filters reach the
parquet scan through Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables as a DataFrame: a parquet scan and nothing
    else. How it is split follows the files and the session's settings."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXE: user_id, tx_id, date, amount (signed), origin, description."""
    return event_transactions(table(spark, sf_dir, "events"))


def event_transactions(ev: DataFrame) -> DataFrame:
    """The TXE view of an events table or stream."""
    negative = F.col("event_type").isin("purchase", "error")
    return ev.select(
        F.col("user_id"),
        F.col("event_id").alias("tx_id"),
        F.col("ts").alias("date"),
        F.when(negative, -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.when(F.col("event_type").isin("purchase", "click"), F.lit("card"))
        .otherwise(F.lit("account")).alias("origin"),
        F.concat(F.col("event_type"), F.lit(".com")).alias("description"),
    )


TXR_ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def transactions_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXR: lineitem joined to its order (user) and part (description).

    orders and part are dimension tables keyed by their primary key; the
    planner chooses the join strategy from runtime sizes (AQE), nothing is
    forced to broadcast here.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    price = F.col("l_extendedprice")
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").alias("date"),
        (F.when(F.col("l_returnflag") == "R", price).otherwise(-price) / F.lit(100.0)).alias("amount"),
        F.when(F.col("l_linestatus") == "F", F.lit("card")).otherwise(F.lit("account")).alias("origin"),
        F.col("p_name").alias("description"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAB: one label row per order: row_id (file order), user_id, label
    (order fully shipped); users repeat, as in the reference's label table."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


SEGMENT_CODES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


def _segment_code(c: Column) -> Column:
    expr = F.lit(len(SEGMENT_CODES))
    for i, name in reversed(list(enumerate(SEGMENT_CODES))):
        expr = F.when(c == name, F.lit(i)).otherwise(expr)
    return expr


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEAT: one row per customer, 3 numerical and 2 categorical columns.

    Orders are pre-aggregated per customer before the join (map-side partial
    aggregate), so the join input is one row per customer, not per order.
    """
    c = table(spark, sf_dir, "customer")
    o = (table(spark, sf_dir, "orders")
         .groupBy("o_custkey")
         .agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s")))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_acctbal").alias("num_acctbal"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("num_orders"),
        F.round(F.coalesce(F.col("s"), F.lit(0.0)), 2).alias("num_spend"),
        F.col("c_nationkey").alias("cat_nation"),
        _segment_code(F.col("c_mktsegment")).alias("cat_segment"),
    )


FEAT_NUMERICAL = ["num_acctbal", "num_orders", "num_spend"]
FEAT_CATEGORICAL = ["cat_nation", "cat_segment"]


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCQ: every document: user_id (= doc_id), text, label (= quality, null where there is none)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("user_id"), "text", F.col("quality").alias("label"))


def split_date_transactions(tx: DataFrame) -> DataFrame:
    """Transactions in the split-date form (client_id, amount >= 0, hour, day,
    month, day_week name, merchant, type in/out) from a signed-amount table."""
    from ledgerloom.functions.encode import weekday_name

    return tx.select(
        F.col("user_id").alias("client_id"),
        *[c for c in ("tx_id",) if c in tx.columns],
        F.col("date"),
        F.abs(F.col("amount")).alias("amount"),
        F.hour("date").alias("hour"),
        F.dayofmonth("date").alias("day"),
        F.month("date").alias("month"),
        weekday_name(F.col("date")).alias("day_week"),
        F.lower(F.col("description")).alias("merchant"),
        F.when(F.col("amount") >= 0, F.lit("in")).otherwise(F.lit("out")).alias("type"),
    )
