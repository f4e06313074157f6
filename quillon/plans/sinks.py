"""Round trips through the sinks: each query writes to a folder of its own and returns what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.session import shared_dir
from quillon.sinks import keyed, tables
from quillon.sources.domain import table

c = F.col


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("sk01_replace_by_key", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS price FROM orders")
def sk01(spark, d):
    path = _folder(spark, "sk01")
    rows = _orders(spark, d).select("o_orderkey", "o_orderstatus", c("o_totalprice").alias("price"))
    tables.replace_by_key(rows, path, "o_orderstatus")
    tables.replace_by_key(rows.where("o_orderstatus = 'O'").withColumn("price", F.lit(0.0)), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "price")


@query("sk02_upsert", "SELECT o_custkey AS client, max(o_totalprice) AS best, count(*) FILTER (o_orderkey % 2 = 0) > 0 AS updated FROM orders GROUP BY 1")
def sk02(spark, d):
    """First the best price of odd orders, then that of all for clients with even ones: replaced or inserted by key."""
    path = _folder(spark, "sk02")
    best = lambda rows, updated: rows.groupBy(c("o_custkey").alias("client")).agg(F.max("o_totalprice").alias("best")).withColumn("updated", F.lit(updated))
    rows = _orders(spark, d)
    tables.upsert(best(rows.where("o_orderkey % 2 = 1"), False), path, ["client"], "best")
    even = rows.where("o_orderkey % 2 = 0").select("o_custkey").distinct()
    tables.upsert(best(rows.join(even, "o_custkey", "left_semi"), True), path, ["client"], "best")
    return tables.read_version(spark, path)


@query("sk03_versions", "SELECT 1 AS version, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders")
def sk03(spark, d):
    path = _folder(spark, "sk03")
    rows = _orders(spark, d)
    tables.append_version(rows.where("o_orderstatus = 'F'"), path)
    tables.append_version(rows, path)
    return spark.read.parquet(path).select("version", "o_orderkey", "o_orderstatus").groupBy("version").agg(F.count("*").alias("n"))


@query("sk04_daily_snapshot", "SELECT '1998-01-02' AS period, count(*) AS n FROM orders UNION ALL SELECT '1998-01-01', count(*) FILTER (o_orderstatus = 'O') FROM orders")
def sk04(spark, d):
    path = _folder(spark, "sk04")
    rows = _orders(spark, d)
    for period, part in (("1998-01-01", rows), ("1998-01-02", rows), ("1998-01-01", rows.where("o_orderstatus = 'O'"))):
        keyed.snapshot(part.agg(F.count("*").alias("n")), path, "dashboard", period)
    return keyed.read(spark, path).select("period", "n")


@query("sk05_csv", """SELECT p_partkey, 'say "' || p_name || '", ' || p_brand AS label FROM part""")
def sk05(spark, d):
    path = _folder(spark, "sk05")
    label = F.concat(F.lit('say "'), "p_name", F.lit('", '), "p_brand")
    tables.to_csv(table(spark, d, "part").select("p_partkey", label.alias("label")), path)
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return back.toDF("p_partkey", "label").select(c("p_partkey").cast("long").alias("p_partkey"), "label")


@query("sk06_json", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders")
def sk06(spark, d):
    path = _folder(spark, "sk06")
    tables.to_json(_orders(spark, d).select("o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_orderstatus")).alias("status")), path)
    return spark.read.schema("o_orderkey long, status string").json(path)


@query("sc08_incremental_load", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def sc08(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    seen = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return tables.unseen(docs.where("text is not null"), "text", seen).select("doc_id", "content_hash")
