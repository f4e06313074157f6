"""Ranking, curation and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import aggregates as agg
from quillon.operators import joins, ranking
from quillon.plans.registry import query
from quillon.sources import domain

ORDER = "l_extendedprice DESC, l_linenumber, l_quantity DESC, l_orderkey, l_suppkey"


def lines(spark, d):
    return domain.table(spark, d, "lineitem")


def order():
    return [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_suppkey")]


@query("w01_rank_and_dedup", f"SELECT l_partkey, l_orderkey, l_linenumber, r AS rank, r = 1 AS rank_winner, CASE WHEN r > 1 THEN 'duplicate_lower_rank' END AS reject_reason FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) AS r FROM lineitem)")
def w01(spark, d):
    return ranking.winners_and_losers(lines(spark, d), ["l_partkey"], order()).select("l_partkey", "l_orderkey", "l_linenumber", "rank", "rank_winner", "reject_reason")


@query("w02_winner_with_history", f"SELECT l_partkey, max(CASE WHEN r = 1 THEN l_orderkey END) AS l_orderkey, max(CASE WHEN r = 1 THEN l_extendedprice END) AS l_extendedprice, count(*) - 1 AS n_losers, round(max(CASE WHEN r = 2 THEN l_extendedprice END), 2) AS runner_up FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) AS r FROM lineitem) GROUP BY 1")
def w02(spark, d):
    h = ranking.with_history(lines(spark, d), ["l_partkey"], order(), ["l_orderkey", "l_extendedprice"])
    return h.select("l_partkey", "l_orderkey", "l_extendedprice", F.size("duplicate_history").cast("long").alias("n_losers"), F.round(F.try_element_at("duplicate_history", F.lit(1))["l_extendedprice"], 2).alias("runner_up"))


def _top(name: str, key: str, sql_order: str, columns: list[str], spark_order, sql_from: str = "lineitem", where: str = "true"):
    """Register a winner-per-key query; the W family differs in key and order alone."""

    @query(name, f"SELECT {', '.join(columns)} FROM {sql_from} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {sql_order}) = 1")
    def run(spark, d):
        rows = domain.table(spark, d, sql_from).where(where)
        return ranking.top_one(rows, [k.strip() for k in key.split(",")], spark_order()).select(*columns)

    return run


c = F.col
_top("w03_mapping_winner", "l_suppkey", "l_discount DESC, l_shipdate, l_orderkey, l_linenumber, l_partkey", ["l_suppkey", "l_orderkey", "l_discount"], lambda: [c("l_discount").desc(), c("l_shipdate"), c("l_orderkey"), c("l_linenumber"), c("l_partkey")])
_top("w05_page_priority", "l_orderkey", "l_linestatus, l_extendedprice DESC, l_linenumber, l_tax DESC, l_partkey", ["l_orderkey", "l_linenumber", "l_linestatus"], lambda: [c("l_linestatus"), c("l_extendedprice").desc(), c("l_linenumber"), c("l_tax").desc(), c("l_partkey")])
_top("w06_best_candidate", "l_orderkey", "l_discount DESC, l_linenumber, l_extendedprice, l_partkey", ["l_orderkey", "l_linenumber", "l_discount"], lambda: [c("l_discount").desc(), c("l_linenumber"), c("l_extendedprice"), c("l_partkey")])
_top("w07_locator_candidate", "o_custkey", "o_orderpriority, o_totalprice DESC, o_orderkey", ["o_custkey", "o_orderkey", "o_orderpriority"], lambda: [c("o_orderpriority"), c("o_totalprice").desc(), c("o_orderkey")], "orders")
_top("sc2_latest_row", "o_custkey", "o_orderdate DESC, o_orderkey", ["o_custkey", "o_orderkey", "o_orderstatus"], lambda: [c("o_orderdate").desc(), c("o_orderkey")], "orders")


@query("w04_merge_sources", """WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_discount AS confidence, 1 AS seq FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_tax, 2 FROM lineitem WHERE l_linestatus = 'O'
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 0.05, 3 FROM lineitem WHERE l_quantity > 25) SELECT l_orderkey, l_partkey, l_suppkey, confidence, seq FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY confidence DESC, seq) = 1""")
def w04(spark, d):
    rows = lines(spark, d)
    part = lambda cond, col, seq: rows.where(cond).select("l_orderkey", "l_partkey", "l_suppkey", col.alias("confidence"), F.lit(seq).alias("seq"))
    s = part("l_returnflag = 'N'", c("l_discount"), 1).unionByName(part("l_linestatus = 'O'", c("l_tax"), 2)).unionByName(part("l_quantity > 25", F.lit(0.05), 3))
    return ranking.top_one(s, ["l_orderkey", "l_partkey", "l_suppkey"], [c("confidence").desc(), c("seq")])


@query("w10_priority_merge", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_orderpriority WHEN o_orderstatus <> 'F' THEN o_orderstatus WHEN o_custkey % 2 = 0 THEN 'even' END AS value,
    CASE WHEN o_totalprice > 200000 THEN 'locator' WHEN o_orderstatus <> 'F' THEN 'validated' WHEN o_custkey % 2 = 0 THEN 'rule' END AS value_source,
    concat_ws('; ', CASE WHEN NOT o_totalprice > 200000 THEN 'locator: rejected' END, CASE WHEN o_orderstatus = 'F' THEN 'validated: rejected' END, CASE WHEN o_custkey % 2 <> 0 THEN 'rule: rejected' END) AS notes FROM orders""")
def w10(spark, d):
    o = domain.table(spark, d, "orders").withColumns({"locator": c("o_orderpriority"), "validated": c("o_orderstatus"), "rule": F.when(c("o_custkey") % 2 == 0, "even").otherwise("odd")})
    return ranking.merged_by_priority(o, "o_orderkey", [("locator", c("o_totalprice") > 200000), ("validated", c("o_orderstatus") != "F"), ("rule", c("o_custkey") % 2 == 0)])


@query("w12_partial_amounts", "WITH v AS (SELECT DISTINCT l_orderkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS digits FROM lineitem) SELECT l_orderkey, digits FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.l_orderkey = v.l_orderkey AND o.digits <> v.digits AND ends_with(o.digits, v.digits))")
def w12(spark, d):
    v = lines(spark, d).select("l_orderkey", c("l_quantity").cast("int").cast("string").alias("digits")).distinct()
    # a longer number knows its own suffixes, so the match is an equi-join
    suffixes = v.select("l_orderkey", F.explode(F.when(F.char_length("digits") > 1, F.transform(F.sequence(F.lit(2), F.char_length("digits")), lambda i: F.substr(c("digits"), i)))).alias("digits"))
    return v.join(suffixes, ["l_orderkey", "digits"], "left_anti")


@query("w13_chunks", "SELECT conv_id, chunk, n_pages, chars FROM (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS chunk, text FROM conversations) GROUP BY 1, 2".replace("n_pages, chars", "count(*) AS n_pages, sum(length(text)) AS chars"))
def w13(spark, d):
    got = ranking.chunked(domain.table(spark, d, "conversations"), "conv_id", "turn", "text", 5)
    marks = F.aggregate("page_numbers", F.lit(0), lambda a, p: a + F.char_length(p.cast("string")) + 14)
    return got.select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.size("page_numbers").cast("long").alias("n_pages"), (F.char_length("text") - marks - 2 * (F.size("page_numbers") - 1)).cast("long").alias("chars"))


@query("w14_packs", "WITH RECURSIVE p AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), f AS (SELECT conv_id, turn, k, n AS used, 0 AS pack FROM p WHERE k = 1 UNION ALL SELECT p.conv_id, p.turn, p.k, CASE WHEN used > 0 AND used + n > 1500 THEN n ELSE used + n END, pack + CASE WHEN used > 0 AND used + n > 1500 THEN 1 ELSE 0 END FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1) SELECT conv_id, turn, pack FROM f")
def w14(spark, d):
    t = domain.table(spark, d, "conversations").withColumn("chars", F.char_length("text"))
    return ranking.packed(t, "conv_id", "turn", "chars", 1500)


@query("w16_unique_keys", "SELECT p_partkey, p_brand || CASE WHEN r > 1 THEN '__' || r ELSE '' END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def w16(spark, d):
    return ranking.suffixed(domain.table(spark, d, "part"), "p_brand", [c("p_partkey")], "unique_key").select("p_partkey", "unique_key")


@query("w18_islands", "WITH t AS (SELECT conv_id, turn, length(text) > 200 AS m, sum(CASE WHEN length(text) > 200 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM t WHERE m GROUP BY conv_id, b HAVING count(*) >= 2")
def w18(spark, d):
    return ranking.islands(domain.table(spark, d, "conversations"), ["conv_id"], "turn", F.char_length("text") > 200)


@query("s03_distinct_first", "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def s03(spark, d):
    return ranking.top_one(lines(spark, d), ["l_orderkey", "l_suppkey"], [c("l_linenumber"), c("l_partkey")]).select("l_orderkey", "l_suppkey", c("l_linenumber").alias("first_line"))


@query("s04_fingerprint_split", "SELECT CASE WHEN r = 1 THEN 'unique' ELSE 'duplicate' END AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) GROUP BY 1")
def s04(spark, d):
    docs = domain.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    part = F.when(c("rank") == 1, "unique").otherwise("duplicate")
    return ranking.numbered(docs, ["fp"], [c("doc_id")]).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("s05_distinct_values", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, lower(p_type), p_size FROM part)")
def s05(spark, d):
    return domain.table(spark, d, "part").select("p_brand", F.lower("p_type"), "p_size").distinct().agg(F.count("*").alias("n"))


@query("s07_except", "SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def s07(spark, d):
    keys = lambda flag: lines(spark, d).where(c("l_returnflag") == flag).select("l_partkey", "l_linenumber")
    return keys("A").distinct().join(keys("R"), ["l_partkey", "l_linenumber"], "left_anti")


@query("a17_dataset_statistics", "SELECT (SELECT count(*) FROM part) AS total, (SELECT floor(avg(p_size) + 0.5) FROM part) AS mean_confidence, (SELECT string_agg(p_brand || '=' || n, ',' ORDER BY p_brand || '=' || n) FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)) AS by_brand, (SELECT string_agg(p_type || '=' || n, ',' ORDER BY p_type || '=' || n) FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)) AS by_type")
def a17(spark, d):
    """Totals, and counts by value of several columns as maps, in one scan; the maps are written out in order."""
    rows = domain.table(spark, d, "part")
    sets = rows.groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type")
    counts = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.floor(F.avg("p_size") + 0.5).cast("double").alias("m"))
    written = lambda g, name: F.array_join(F.array_sort(F.collect_list(F.when(c("g") == g, F.concat(name, F.lit("="), c("n").cast("string"))))), ",")
    return counts.agg(F.max(F.when(c("g") == 3, c("n"))).alias("total"), F.max(F.when(c("g") == 3, c("m"))).alias("mean_confidence"), written(1, "p_brand").alias("by_brand"), written(2, "p_type").alias("by_type"))


@query("a18_confidence_statistics", "SELECT count(*) AS total, floor(avg(p_size) + 0.5) AS mean, count(*) FILTER (p_size >= 40) AS high, count(*) FILTER (p_size < 40) AS low FROM part")
def a18(spark, d):
    s = c("p_size")
    return domain.table(spark, d, "part").agg(F.count("*").alias("total"), F.floor(F.avg(s) + 0.5).cast("double").alias("mean"), agg.count_if(s >= 40).alias("high"), agg.count_if(s < 40).alias("low"))


@query("j10_fuzzy_pairs", "WITH v AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 4) AS similarity FROM v a, v b WHERE a.n < b.n AND 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) >= 0.7")
def j10(spark, d):
    return joins.fuzzy_pairs(domain.table(spark, d, "part"), "p_name", 0.7)
