"""Domain tables: tenders, contracts, finance records, users and logs as views over the stored tables.

The stored tables have no tender data, so orders stand for tenders, revenue of their lines for contract
values, lines for finance records, suppliers for users and events for logs. Each view is a projection that pushes down to the
scan. ``SQL`` holds the same views as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-01-01 00:00:00"
RECORD_TYPES = ("EMD", "BG", "PBG", "SD", "TENDER_FEE", "PROCESSING_FEE")
CATEGORIES = ("Security", "Housekeeping", "Manpower", "Horticulture", "Facility Management", "Other Categories")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "AWARDED").when(F.col("o_orderstatus") == "O", "SUBMITTED").otherwise("REJECTED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tender_id"),
        F.col("o_custkey").alias("client_id"),
        status.alias("status"),
        F.col("o_totalprice").alias("estimated_value"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_custkey") % 100 + 1).alias("created_by"),
        (F.col("o_orderkey") % 100 + 1).alias("assigned_executive"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract for each awarded tender with lines: its value, and the date on which it ends."""
    won = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate")
    value = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lines.join(won, lines["l_orderkey"] == won["o_orderkey"], "left_semi").groupBy(F.col("l_orderkey").alias("tender_id")).agg(
        value.alias("contract_value"), F.max(F.col("l_shipdate").cast("timestamp")).alias("contract_end")
    )


def finance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, RECORD_TYPES)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "R", "Refunded").when(F.col("l_linestatus") == "O", "Active").when(F.col("l_returnflag") == "A", "Pending").otherwise("Received")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        F.col("l_orderkey").alias("tender_id"),
        kind.alias("record_type"),
        status.alias("status"),
        F.when(F.col("l_quantity") > 30, "received").when(F.col("l_quantity") > 10, "pending").alias("refund_status"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("expiry_date"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("department"))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several classifications a tender, numbered in the order they were made."""
    raw = F.element_at(F.array(*map(F.lit, ("Security Services", "Housekeeping Services", "Manpower Services", "Horticulture", "Facility Management", "Catering", ""))), (F.col("l_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("seq"), raw.alias("service_category"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", F.col("event_type").alias("action"), "value", "props")


#: The same views for SQL, to stand in a WITH clause.
SQL = {
    "tenders": """tenders AS (SELECT o_orderkey AS tender_id, o_custkey AS client_id,
        CASE o_orderstatus WHEN 'P' THEN 'AWARDED' WHEN 'O' THEN 'SUBMITTED' ELSE 'REJECTED' END AS status,
        o_totalprice AS estimated_value, o_orderdate AS updated_at, o_orderpriority AS priority,
        o_custkey % 100 + 1 AS created_by, o_orderkey % 100 + 1 AS assigned_executive FROM orders)""",
    "contracts": """contracts AS (SELECT l_orderkey AS tender_id, sum(l_extendedprice * (1 - l_discount)) AS contract_value,
        max(l_shipdate) AS contract_end FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1)""",
    "finance": """finance AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, l_orderkey AS tender_id,
        ['EMD','BG','PBG','SD','TENDER_FEE','PROCESSING_FEE'][l_linenumber % 6 + 1] AS record_type,
        CASE WHEN l_returnflag = 'R' THEN 'Refunded' WHEN l_linestatus = 'O' THEN 'Active' WHEN l_returnflag = 'A' THEN 'Pending' ELSE 'Received' END AS status,
        CASE WHEN l_quantity > 30 THEN 'received' WHEN l_quantity > 10 THEN 'pending' END AS refund_status,
        l_extendedprice AS amount, l_shipdate AS expiry_date FROM lineitem)""",
    "users": "users AS (SELECT s_suppkey AS user_id, s_name AS name, s_nationkey AS department FROM supplier)",
    "classifications": """classifications AS (SELECT l_orderkey AS tender_id, l_linenumber AS seq,
        ['Security Services','Housekeeping Services','Manpower Services','Horticulture','Facility Management','Catering',''][l_partkey % 7 + 1] AS service_category FROM lineitem)""",
    "logs": "logs AS (SELECT event_id AS log_id, ts AS created_at, user_id, event_type AS action, value, props FROM events)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
