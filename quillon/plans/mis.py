"""Management reporting: performance, values, finance, contracts, users, alerts, feeds, search and pages."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from quillon.functions import dates
from quillon.operators import aggregates as agg
from quillon.operators import filters, joins, paging, ranking
from quillon.plans.registry import query
from quillon.sources import domain
from quillon.sources.domain import AS_OF, CATEGORIES, RECORD_TYPES, with_

TS = f"TIMESTAMP '{AS_OF}'"
DAYS_SQL = f"CAST(ceil((epoch_us({{0}}) - epoch_us({TS})) / 86400000000.0) AS BIGINT)"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _flags(t):
    return t.withColumns({"participated": F.col("status").isin("SUBMITTED", "AWARDED"), "won": F.col("status") == "AWARDED"})


# filters ---------------------------------------------------------------------------------------------------------


@query("pf01_status_filter", with_("tenders") + "SELECT priority, count(*) AS n, count(*) FILTER (status <> 'AWARDED') AS not_awarded FROM tenders WHERE status IN ('SUBMITTED','AWARDED') GROUP BY 1")
def pf01(spark, d):
    t = domain.tenders(spark, d).where(F.col("status").isin("SUBMITTED", "AWARDED"))
    return t.groupBy("priority").agg(F.count("*").alias("n"), agg.count_if(filters.not_equal(F.col("status"), "AWARDED")).alias("not_awarded"))


@query("pf02_date_range", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def pf02(spark, d):
    t = domain.table(spark, d, "orders")
    return t.where(filters.date_range(F.col("o_orderdate"), "1996-01-01", "1996-12-31")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("pf03_regex_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^.*RED')")
def pf03(spark, d):
    return domain.table(spark, d, "part").where(filters.matches(F.col("p_name"), "^.*RED")).select("p_partkey", "p_name")


@query("pf04_search", "SELECT * FROM (SELECT * FROM (SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS title FROM supplier WHERE s_name ILIKE '%0000%' ORDER BY s_suppkey LIMIT 25) UNION ALL SELECT * FROM (SELECT 'customer', c_custkey, c_name FROM customer WHERE c_name ILIKE '%0000%' OR c_mktsegment ILIKE '%0000%' ORDER BY c_custkey LIMIT 25)) ORDER BY kind, id LIMIT 40")
def pf04(spark, d):
    """At most 25 hits of each source, and 40 in all."""
    s = filters.search(domain.table(spark, d, "supplier"), "0000", ["s_name"]).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    c = filters.search(domain.table(spark, d, "customer"), "0000", ["c_name", "c_mktsegment"]).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    top = [x.orderBy("id").limit(25) for x in (s, c)]
    return top[0].unionByName(top[1]).orderBy("kind", "id").limit(40)


@query("pf05_exact_match", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'BUILDING'")
def pf05(spark, d):
    return filters.search(domain.table(spark, d, "customer"), "BUILDING", ["c_mktsegment", "c_name"], exact=True).select("c_custkey", "c_name")


@query("pf06_filled", with_("classifications") + "SELECT tender_id, count(*) AS n FROM classifications WHERE service_category IS NOT NULL AND service_category <> '' GROUP BY 1")
def pf06(spark, d):
    return domain.classifications(spark, d).where(filters.filled(F.col("service_category"))).groupBy("tender_id").agg(F.count("*").alias("n"))


@query("pf07_own_rows", with_("tenders") + "SELECT status, count(*) AS n FROM tenders WHERE created_by = 7 OR assigned_executive = 7 GROUP BY 1")
def pf07(spark, d):
    return filters.own_rows(domain.tenders(spark, d), 7, ["created_by", "assigned_executive"]).groupBy("status").agg(F.count("*").alias("n"))


LABEL_SQL = "CASE service_category WHEN 'Security Services' THEN 'Security' WHEN 'Housekeeping Services' THEN 'Housekeeping' WHEN 'Manpower Services' THEN 'Manpower' WHEN 'Horticulture' THEN 'Horticulture' WHEN 'Facility Management' THEN 'Facility Management' ELSE 'Other Categories' END"


@query("pf08_category_label", with_("classifications") + f"SELECT service_category, {LABEL_SQL} AS label, count(*) AS n FROM classifications GROUP BY 1, 2")
def pf08(spark, d):
    c = domain.classifications(spark, d)
    return c.groupBy("service_category", filters.category_label(F.col("service_category")).alias("label")).agg(F.count("*").alias("n"))


@query("pf09_expiry_status", with_("finance") + f"""SELECT CASE WHEN status = 'Released' THEN status WHEN d IS NULL THEN status WHEN d < 0 THEN 'Expired' WHEN d <= 30 THEN 'Expiring Soon' ELSE 'Active' END AS expiry_status,
    count(*) AS n, min(d) AS least_days, max(d) AS most_days FROM (SELECT status, {DAYS_SQL.format('expiry_date')} AS d FROM finance) GROUP BY 1""")
def pf09(spark, d):
    f = domain.finance_records(spark, d).withColumn("days", dates.days_until(F.col("expiry_date"), as_of()))
    return f.groupBy(filters.expiry_status(F.col("days"), F.col("status")).alias("expiry_status")).agg(F.count("*").alias("n"), F.min("days").alias("least_days"), F.max("days").alias("most_days"))


@query("pf10_requirement_status", with_("tenders", "finance") + """, x AS (SELECT t.tender_id, estimated_value * 0.02 AS required, coalesce(tracked, 0) AS tracked FROM tenders t
    LEFT JOIN (SELECT tender_id, sum(amount) AS tracked FROM finance WHERE record_type = 'EMD' GROUP BY 1) f USING (tender_id))
    SELECT CASE WHEN required <= 0 THEN CASE WHEN tracked > 0 THEN 'complete' ELSE 'not_required' END WHEN tracked > required THEN 'overpaid' WHEN tracked = required THEN 'complete' WHEN tracked > 0 THEN 'partial' ELSE 'pending' END AS requirement_status,
    count(*) AS n, round(sum(greatest(0, required - tracked)), 2) AS remaining FROM x GROUP BY 1""")
def pf10(spark, d):
    paid = domain.finance_records(spark, d).where("record_type = 'EMD'").groupBy("tender_id").agg(F.sum("amount").alias("tracked"))
    x = domain.tenders(spark, d).select("tender_id", (F.col("estimated_value") * 0.02).alias("required")).join(paid, "tender_id", "left").fillna(0.0, ["tracked"])
    status = filters.requirement_status(F.col("required"), F.col("tracked"))
    return x.groupBy(status.alias("requirement_status")).agg(F.count("*").alias("n"), F.round(F.sum(filters.remaining(F.col("required"), F.col("tracked"))), 2).alias("remaining"))


@query("pf11_confidence_tier", "SELECT CASE WHEN p_size * 2 >= 95 THEN 'verified' WHEN p_size * 2 >= 85 THEN 'high' WHEN p_size * 2 >= 70 THEN 'review' ELSE 'low' END AS tier, count(*) AS n, bool_and(p_size * 2 < 70) AS hidden FROM part GROUP BY 1")
def pf11(spark, d):
    score = F.col("p_size") * 2
    return domain.table(spark, d, "part").groupBy(filters.confidence_tier(score).alias("tier")).agg(F.count("*").alias("n"), F.bool_and(score < 70).alias("hidden"))


# joins -----------------------------------------------------------------------------------------------------------


@query("j01_lookup", with_("tenders") + "SELECT tender_id, status, c_name, c_mktsegment, n_name FROM tenders LEFT JOIN customer ON client_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j01(spark, d):
    c = domain.table(spark, d, "customer")
    two = joins.lookup(domain.tenders(spark, d).select("tender_id", "status", "client_id"), c, "client_id", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])
    return joins.lookup(two, domain.table(spark, d, "nation"), "c_nationkey", "n_nationkey", ["n_name"]).select("tender_id", "status", "c_name", "c_mktsegment", "n_name")


@query("j03_semi_join", with_("tenders", "finance") + "SELECT record_type, count(*) AS n, round(sum(amount), 2) AS amount FROM finance WHERE tender_id IN (SELECT tender_id FROM tenders WHERE status = 'AWARDED') GROUP BY 1")
def j03(spark, d):
    won = domain.tenders(spark, d).where("status = 'AWARDED'")
    return joins.within(domain.finance_records(spark, d), won, "tender_id", strict=True).groupBy("record_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("j04_empty_bypass", with_("finance") + "SELECT record_type, count(*) AS n FROM finance GROUP BY 1")
def j04(spark, d):
    nobody = domain.tenders(spark, d).where("status = 'WITHDRAWN'")
    return joins.within(domain.finance_records(spark, d), nobody, "tender_id").groupBy("record_type").agg(F.count("*").alias("n"))


@query("a12_j05_executives", with_("tenders", "users") + """, x AS (SELECT DISTINCT tender_id, status, u FROM (SELECT tender_id, status, created_by AS u FROM tenders UNION ALL SELECT tender_id, status, assigned_executive FROM tenders)),
    p AS (SELECT user_id, count(*) AS pending FROM logs_ GROUP BY 1),
    g AS (SELECT u, count(*) AS assigned, count(*) FILTER (status IN ('SUBMITTED','AWARDED')) AS submitted, count(*) FILTER (status = 'AWARDED') AS awarded FROM x GROUP BY 1)
    SELECT user_id, name, coalesce(assigned, 0) AS assigned, coalesce(submitted, 0) AS submitted, coalesce(awarded, 0) AS awarded,
    CASE WHEN coalesce(submitted, 0) > 0 THEN floor(awarded / submitted * 10000 + 0.5) / 100 ELSE 0 END AS win_percent, coalesce(pending, 0) AS pending
    FROM users LEFT JOIN g ON u = user_id LEFT JOIN p USING (user_id)""".replace("logs_", "(SELECT user_id FROM events WHERE event_type = 'click')"))
def a12(spark, d):
    x = joins.by_either(domain.tenders(spark, d), ["created_by", "assigned_executive"], "user_id")
    g = x.groupBy("user_id").agg(F.count("*").alias("assigned"), agg.count_if(F.col("status").isin("SUBMITTED", "AWARDED")).alias("submitted"), agg.count_if(F.col("status") == "AWARDED").alias("awarded"))
    pending = domain.logs(spark, d).where("action = 'click'").groupBy("user_id").agg(F.count("*").alias("pending"))
    out = domain.users(spark, d).join(g, "user_id", "left").join(pending, "user_id", "left").fillna(0, ["assigned", "submitted", "awarded", "pending"])
    return out.select("user_id", "name", "assigned", "submitted", "awarded", agg.percent(F.col("awarded"), F.col("submitted")).alias("win_percent"), "pending")


@query("j06_tasks_per_user", "SELECT user_id, count(*) AS pending FROM events WHERE event_type = 'click' GROUP BY 1")
def j06(spark, d):
    return domain.logs(spark, d).where("action = 'click'").groupBy("user_id").agg(F.count("*").alias("pending"))


@query("j07_latest_child", with_("tenders") + "SELECT tender_id, status, r.l_linenumber AS line, r.l_shipdate AS shipped FROM tenders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1) r ON l_orderkey = tender_id")
def j07(spark, d):
    lines = domain.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "tender_id")
    order = [F.col("l_shipdate").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    out = joins.latest_child(domain.tenders(spark, d).select("tender_id", "status"), lines, "tender_id", order, ["l_linenumber", "l_shipdate"])
    return out.select("tender_id", "status", F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"))


@query("j15_version_diff", "WITH o AS (SELECT l_partkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT l_partkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-01' GROUP BY 1) SELECT count(*) FILTER (o.k IS NULL) AS added, count(*) FILTER (n.k IS NULL) AS removed, count(*) FILTER (o.k IS NOT NULL AND n.k IS NOT NULL AND o.v IS DISTINCT FROM n.v) AS value_changed FROM o FULL JOIN n USING (k)")
def j15(spark, d):
    lines = domain.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_extendedprice", "l_shipdate")
    cut = lambda cond: lines.where(cond).groupBy("k").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return joins.difference(cut("l_shipdate < timestamp '1998-01-01'"), cut("l_shipdate >= timestamp '1996-06-01'"), "k", "v")


@query("j16_stale_alerts", with_("finance") + f"SELECT record_id, record_type FROM finance WHERE status = 'Active' AND record_id NOT IN (SELECT record_id FROM finance WHERE {DAYS_SQL.format('expiry_date')} <= 30)")
def j16(spark, d):
    f = domain.finance_records(spark, d)
    active = f.where(dates.days_until(F.col("expiry_date"), as_of()) <= 30).select("record_id")
    return f.where("status = 'Active'").join(active, "record_id", "left_anti").select("record_id", "record_type")


@query("j17_rejected_by_dictionary", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_returnflag = 'N' AND o.l_partkey = l.l_partkey AND o.l_suppkey = l.l_suppkey)")
def j17(spark, d):
    lines = domain.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return lines.where("l_returnflag = 'A'").join(lines.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_partkey").distinct()


# aggregates ------------------------------------------------------------------------------------------------------


@query("a01_group_count", with_("tenders") + "SELECT assigned_executive, count(*) AS n FROM tenders WHERE status = 'SUBMITTED' GROUP BY 1")
def a01(spark, d):
    return domain.tenders(spark, d).where("status = 'SUBMITTED'").groupBy("assigned_executive").agg(F.count("*").alias("n"))


STATUSES = ("DRAFT", "SUBMITTED", "AWARDED", "REJECTED", "WITHDRAWN")


@query("a02_zero_filled_status", with_("tenders") + "SELECT s AS status, count(tender_id) AS n FROM (SELECT unnest(['DRAFT','SUBMITTED','AWARDED','REJECTED','WITHDRAWN']) AS s) LEFT JOIN tenders ON status = s GROUP BY 1")
def a02(spark, d):
    counts = domain.tenders(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return agg.zero_filled(counts, "status", STATUSES, ["n"]).drop("bucket_order")


PERFORMANCE_SQL = "count(*) FILTER (status IN ('SUBMITTED','AWARDED')) AS participated, count(*) FILTER (status = 'AWARDED') AS won, count(*) FILTER (status = 'SUBMITTED') AS lost, CASE WHEN count(*) FILTER (status IN ('SUBMITTED','AWARDED')) > 0 THEN floor(count(*) FILTER (status = 'AWARDED') / count(*) FILTER (status IN ('SUBMITTED','AWARDED')) * 10000 + 0.5) / 100 ELSE 0 END AS win_rate"
PERFORMANCE_SEGMENT_SQL = with_("tenders") + f"SELECT c_mktsegment AS segment, {PERFORMANCE_SQL} FROM tenders LEFT JOIN customer ON c_custkey = client_id GROUP BY 1"


def performance():
    part = agg.count_if(F.col("status").isin("SUBMITTED", "AWARDED"))
    won = agg.count_if(F.col("status") == "AWARDED")
    return [part.alias("participated"), won.alias("won"), agg.count_if(F.col("status") == "SUBMITTED").alias("lost"), agg.percent(won, part).alias("win_rate")]


@query("a03_win_rate", with_("tenders") + f"SELECT {PERFORMANCE_SQL} FROM tenders")
def a03(spark, d):
    return domain.tenders(spark, d).agg(*performance())


@query("a03_win_rate_by_segment", PERFORMANCE_SEGMENT_SQL)
def a03_by_segment(spark, d):
    t = domain.tenders(spark, d).select("client_id", "status")
    return joins.lookup(t, domain.table(spark, d, "customer"), "client_id", "c_custkey", ["c_mktsegment"]).groupBy(F.col("c_mktsegment").alias("segment")).agg(*performance())


@query("a04_j02_tender_value", with_("tenders", "contracts") + "SELECT round(sum(estimated_value), 2) AS total_value, round(sum(CASE WHEN status = 'AWARDED' THEN coalesce(contract_value, estimated_value) ELSE 0 END), 2) AS awarded_value, round(greatest(0, sum(estimated_value) - sum(CASE WHEN status = 'AWARDED' THEN coalesce(contract_value, estimated_value) ELSE 0 END)), 2) AS lost_value FROM tenders LEFT JOIN contracts USING (tender_id) WHERE status <> 'REJECTED'")
def a04(spark, d):
    t = domain.tenders(spark, d).where(F.col("status").isin("SUBMITTED", "AWARDED")).select("tender_id", "status", "estimated_value")
    v = t.join(domain.contracts(spark, d), "tender_id", "left")
    won = F.sum(F.when(F.col("status") == "AWARDED", F.coalesce("contract_value", "estimated_value")).otherwise(0.0))
    total = F.sum("estimated_value")
    return v.agg(F.round(total, 2).alias("total_value"), F.round(won, 2).alias("awarded_value"), F.round(F.greatest(F.lit(0.0), total - won), 2).alias("lost_value"))


@query("a05_category_counts", with_("classifications") + f", f AS (SELECT {LABEL_SQL} AS category FROM (SELECT * FROM classifications QUALIFY row_number() OVER (PARTITION BY tender_id ORDER BY seq, service_category) = 1)) SELECT c.category, count(f.category) AS n FROM (SELECT unnest(['Security','Housekeeping','Manpower','Horticulture','Facility Management','Other Categories']) AS category) c LEFT JOIN f USING (category) GROUP BY 1")
def a05(spark, d):
    first = ranking.top_one(domain.classifications(spark, d), ["tender_id"], [F.col("seq"), F.col("service_category")])
    counts = first.groupBy(filters.category_label(F.col("service_category")).alias("category")).agg(F.count("*").alias("n"))
    return agg.zero_filled(counts, "category", CATEGORIES, ["n"]).drop("bucket_order")


@query("a06_finance_summary", with_("finance") + """SELECT round(sum(CASE WHEN record_type = 'EMD' AND status <> 'Refunded' AND refund_status IS DISTINCT FROM 'received' THEN amount ELSE 0 END), 2) AS emd_locked,
    round(sum(CASE WHEN record_type = 'EMD' AND (status = 'Refunded' OR refund_status = 'received') THEN amount ELSE 0 END), 2) AS emd_refunded,
    round(sum(CASE WHEN refund_status = 'pending' THEN amount ELSE 0 END), 2) AS pending_refund,
    round(sum(CASE WHEN record_type = 'BG' AND status IN ('Received','Active','Expiring Soon') THEN amount ELSE 0 END), 2) AS bg_received,
    round(sum(CASE WHEN record_type = 'BG' AND status IN ('Pending','Requested') THEN amount ELSE 0 END), 2) AS bg_pending,
    round(sum(CASE WHEN record_type = 'BG' AND status IN ('Active','Expiring Soon') THEN amount ELSE 0 END), 2) AS bg_active FROM finance""")
def a06(spark, d):
    is_ = lambda kind, *s: (F.col("record_type") == kind) & F.col("status").isin(*s)
    back = (F.col("status") == "Refunded") | F.coalesce(F.col("refund_status") == "received", F.lit(False))
    emd, amount = F.col("record_type") == "EMD", F.col("amount")
    return domain.finance_records(spark, d).agg(
        agg.sum_if(emd & ~back, amount).alias("emd_locked"), agg.sum_if(emd & back, amount).alias("emd_refunded"),
        agg.sum_if(F.col("refund_status") == "pending", amount).alias("pending_refund"),
        agg.sum_if(is_("BG", "Received", "Active", "Expiring Soon"), amount).alias("bg_received"),
        agg.sum_if(is_("BG", "Pending", "Requested"), amount).alias("bg_pending"), agg.sum_if(is_("BG", "Active", "Expiring Soon"), amount).alias("bg_active"),
    )


@query("a07_sum_by_type", with_("finance") + "SELECT coalesce(record_type, 'TOTAL') AS record_type, count(*) AS n, round(sum(amount), 2) AS amount FROM finance GROUP BY ROLLUP (record_type)")
def a07(spark, d):
    return domain.finance_records(spark, d).rollup("record_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")).withColumn("record_type", F.coalesce("record_type", F.lit("TOTAL")))


BG_OUT = f"({DAYS_SQL.format('expiry_date')} < 0 AND status <> 'Refunded')"


@query("a08_finance_overview", with_("finance") + f"""SELECT round(sum(CASE WHEN record_type = 'EMD' AND refund_status IS DISTINCT FROM 'received' AND status <> 'Refunded' THEN amount ELSE 0 END), 2) AS emd_locked, round(sum(CASE WHEN record_type = 'EMD' AND (refund_status = 'received' OR status = 'Refunded') THEN amount ELSE 0 END), 2) AS emd_refunded,
    round(sum(CASE WHEN refund_status <> 'received' THEN amount ELSE 0 END), 2) AS pending_refund, round(sum(CASE WHEN record_type = 'BG' AND status IN ('Active','Expiring Soon') THEN amount ELSE 0 END), 2) AS bg_active, round(sum(CASE WHEN record_type = 'BG' AND status IN ('Pending','Requested') THEN amount ELSE 0 END), 2) AS bg_pending,
    round(sum(CASE WHEN record_type = 'BG' AND {BG_OUT} THEN amount ELSE 0 END), 2) AS bg_expired, round(sum(CASE WHEN record_type = 'TENDER_FEE' AND (status = 'Received' OR refund_status IS NOT NULL) THEN amount ELSE 0 END), 2) AS fees_paid, round(sum(CASE WHEN record_type = 'SD' THEN amount ELSE 0 END), 2) AS deposits,
    round(sum(CASE WHEN record_type = 'PBG' AND status IN ('Active','Expiring Soon') THEN amount ELSE 0 END), 2) AS pbg_active, round(sum(CASE WHEN record_type = 'PBG' AND {BG_OUT} THEN amount ELSE 0 END), 2) AS pbg_expired, round(sum(CASE WHEN record_type = 'PBG' AND status IN ('Pending','Requested') THEN amount ELSE 0 END), 2) AS pbg_pending FROM finance""")
def a08(spark, d):
    """Eleven sums in one scan. Received fees, or those with a refund, count as paid; a released guarantee does not expire."""
    f = domain.finance_records(spark, d).withColumn("days", dates.days_until(F.col("expiry_date"), as_of()))
    kind = lambda k: F.col("record_type") == k
    status, back = F.col("status"), F.coalesce(F.col("refund_status") == "received", F.lit(False)) | (F.col("status") == "Refunded")
    active, waits, out = status.isin("Active", "Expiring Soon"), status.isin("Pending", "Requested"), (F.col("days") < 0) & (status != "Refunded")
    measures = {
        "emd_locked": kind("EMD") & ~back, "emd_refunded": kind("EMD") & back, "pending_refund": F.col("refund_status") != "received", "bg_active": kind("BG") & active, "bg_pending": kind("BG") & waits, "bg_expired": kind("BG") & out,
        "fees_paid": kind("TENDER_FEE") & ((status == "Received") | F.col("refund_status").isNotNull()), "deposits": kind("SD"), "pbg_active": kind("PBG") & active, "pbg_expired": kind("PBG") & out, "pbg_pending": kind("PBG") & waits}
    return f.agg(*[agg.sum_if(condition, F.col("amount")).alias(name) for name, condition in measures.items()])


@query("a09_d09_contract_windows", with_("contracts") + f"SELECT count(*) FILTER (contract_end >= {TS}) AS running, count(*) FILTER (contract_end < {TS} AND tender_id % 3 = 0) AS completed, count(*) FILTER (contract_end < {TS} AND tender_id % 3 <> 0) AS expired, count(*) FILTER (contract_end BETWEEN {TS} AND {TS} + INTERVAL 30 DAY) AS in_30, count(*) FILTER (contract_end BETWEEN {TS} AND {TS} + INTERVAL 60 DAY) AS in_60, count(*) FILTER (contract_end BETWEEN {TS} AND {TS} + INTERVAL 90 DAY) AS in_90 FROM contracts")
def a09(spark, d):
    """Counts by status, and of contracts that end within windows from now on, each of which holds the shorter ones."""
    end = F.col("contract_end")
    status = F.when(end >= as_of(), "active").when(F.col("tender_id") % 3 == 0, "completed").otherwise("expired")
    within = lambda n: agg.count_if(end.between(as_of(), as_of() + F.expr(f"interval {n} days"))).alias(f"in_{n}")
    of = lambda name, *s: agg.count_if(F.col("s").isin(*s)).alias(name)
    return domain.contracts(spark, d).withColumn("s", status).agg(of("running", "active", "expiring_soon"), of("completed", "completed"), of("expired", "expired"), within(30), within(60), within(90))


@query("a10_revenue", with_("contracts", "finance") + "SELECT r.*, i.* FROM (SELECT count(*) AS contracts, round(sum(contract_value), 2) AS revenue FROM contracts) r, (SELECT count(*) AS invoices, count(*) FILTER (status = 'Received') AS paid, count(*) FILTER (status <> 'Received') AS unpaid FROM finance) i")
def a10(spark, d):
    r = domain.contracts(spark, d).agg(F.count("*").alias("contracts"), F.round(F.sum("contract_value"), 2).alias("revenue"))
    paid = F.col("status") == "Received"
    i = domain.finance_records(spark, d).agg(F.count("*").alias("invoices"), agg.count_if(paid).alias("paid"), agg.count_if(~paid).alias("unpaid"))
    return agg.side_by_side(r, i)


@query("a11_tender_overview", with_("tenders") + "SELECT count(*) AS total, count(*) FILTER (status IN ('SUBMITTED','AWARDED')) AS participated, count(*) FILTER (status = 'AWARDED') AS awarded, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (updated_at >= TIMESTAMP '1998-01-01') AS recent, round(avg(estimated_value), 2) AS mean_value, round(max(estimated_value), 2) AS largest FROM tenders")
def a11(spark, d):
    s = F.col("status")
    return domain.tenders(spark, d).agg(
        F.count("*").alias("total"), agg.count_if(s.isin("SUBMITTED", "AWARDED")).alias("participated"), agg.count_if(s == "AWARDED").alias("awarded"), agg.count_if(s == "REJECTED").alias("rejected"),
        agg.count_if(F.col("updated_at") >= as_of()).alias("recent"), F.round(F.avg("estimated_value"), 2).alias("mean_value"), F.round(F.max("estimated_value"), 2).alias("largest"))


@query("a13_contract_summary", with_("contracts") + f"SELECT count(*) AS total, count(*) FILTER (contract_end >= {TS}) AS active, count(*) FILTER (contract_end BETWEEN {TS} AND {TS} + INTERVAL 30 DAY) AS expiring_soon, count(*) FILTER (contract_end - INTERVAL 45 DAY BETWEEN {TS} AND {TS} + INTERVAL 30 DAY) AS amc_expiring_soon, round(sum(contract_value), 2) AS revenue, round(sum(CASE WHEN tender_id % 4 <> 0 THEN contract_value ELSE 0 END), 2) AS received, round(sum(CASE WHEN tender_id % 4 = 0 THEN contract_value ELSE 0 END), 2) AS pending, round(sum(CASE WHEN tender_id % 8 = 0 THEN contract_value ELSE 0 END), 2) AS pending_billing FROM contracts")
def a13(spark, d):
    """Always over all contracts. Every fourth contract's revenue is pending here, every eighth's billing."""
    end, v, k = F.col("contract_end"), F.col("contract_value"), F.col("tender_id")
    soon = lambda x: agg.count_if(x.between(as_of(), as_of() + F.expr("interval 30 days")))
    return domain.contracts(spark, d).agg(
        F.count("*").alias("total"), agg.count_if(end >= as_of()).alias("active"), soon(end).alias("expiring_soon"), soon(end - F.expr("interval 45 days")).alias("amc_expiring_soon"), F.round(F.sum(v), 2).alias("revenue"),
        agg.sum_if(k % 4 != 0, v).alias("received"), agg.sum_if(k % 4 == 0, v).alias("pending"), agg.sum_if(k % 8 == 0, v).alias("pending_billing"))


@query("a14_workflow_widgets", with_("finance") + f"SELECT count(*) FILTER (status = 'Pending') AS pending_approvals, count(*) FILTER (status = 'Active') AS approved, count(*) FILTER (refund_status = 'pending') AS pending_refunds, count(*) FILTER (record_type = 'BG' AND {DAYS_SQL.format('expiry_date')} BETWEEN 0 AND 30) AS bg_expiring, count(*) FILTER (record_type = 'PBG' AND {DAYS_SQL.format('expiry_date')} BETWEEN 0 AND 30) AS pbg_expiring, count(*) FILTER (status IS DISTINCT FROM 'Refunded') AS open_tasks FROM finance")
def a14(spark, d):
    """Six counts in one scan, over all rows whoever asks."""
    f = domain.finance_records(spark, d).withColumn("level", dates.expiry_level(dates.days_until(F.col("expiry_date"), as_of())))
    status, due = F.col("status"), F.col("level").isin("30_days", "15_days", "7_days")
    return f.agg(
        agg.count_if(status == "Pending").alias("pending_approvals"), agg.count_if(status == "Active").alias("approved"), agg.count_if(F.col("refund_status") == "pending").alias("pending_refunds"),
        agg.count_if((F.col("record_type") == "BG") & due).alias("bg_expiring"), agg.count_if((F.col("record_type") == "PBG") & due).alias("pbg_expiring"), agg.count_if(filters.not_equal(status, "Refunded")).alias("open_tasks"))


PRIORITY_SQL = "CASE WHEN {0} <= 7 THEN 'critical' WHEN {0} <= 15 THEN 'high' WHEN {0} <= 30 THEN 'medium' ELSE 'low' END"


@query("a21_al03_alert_buckets", with_("finance") + f", a AS (SELECT {PRIORITY_SQL.format('d')} AS priority FROM (SELECT {DAYS_SQL.format('expiry_date')} AS d FROM finance WHERE status = 'Active')) SELECT p AS priority, count(a.priority) AS n FROM (SELECT unnest(['critical','high','medium','low']) AS p) LEFT JOIN a ON a.priority = p GROUP BY 1")
def a21(spark, d):
    f = domain.finance_records(spark, d).where("status = 'Active'")
    counts = f.groupBy(dates.alert_priority(dates.days_until(F.col("expiry_date"), as_of())).alias("priority")).agg(F.count("*").alias("n"))
    return agg.zero_filled(counts, "priority", ("critical", "high", "medium", "low"), ["n"]).drop("bucket_order")


@query("a22_learning_registry", """WITH f AS (SELECT p_brand AS parameter, p_type, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r, p_partkey FROM part), e AS (SELECT parameter, p_name, row_number() OVER (PARTITION BY parameter ORDER BY p_partkey) AS k FROM f WHERE r = 1)
    SELECT parameter, count(*) AS frequency, count(DISTINCT p_type) AS categories, count(*) >= 50 AS promoted, (SELECT string_agg(p_name, '|' ORDER BY k) FROM e WHERE e.parameter = f.parameter AND k <= 20) AS examples FROM f GROUP BY parameter""")
def a22(spark, d):
    """How often a parameter was seen, its categories, its first twenty different examples of up to 200 characters, and promotion from 50 on."""
    rows = domain.table(spark, d, "part").select(F.col("p_brand").alias("parameter"), "p_type", F.substring("p_name", 1, 200).alias("example"), "p_partkey")
    # an example's first place is combined before anything is collected, and only twenty of a key are
    first = rows.groupBy("parameter", "example").agg(F.min("p_partkey").alias("at"))
    kept = ranking.numbered(first, ["parameter"], [F.col("at")], "k").where("k <= 20").groupBy("parameter").agg(F.array_sort(F.collect_list(F.struct("k", "example"))).alias("e"))
    counts = rows.groupBy("parameter").agg(F.count("*").alias("frequency"), F.countDistinct("p_type").alias("categories"))
    return counts.join(kept, "parameter").select("parameter", "frequency", "categories", (F.col("frequency") >= 50).alias("promoted"), F.array_join(F.transform("e", lambda x: x["example"]), "|").alias("examples"))


RULE_NAMES = ("forbidden_context", "bid_end_before_start", "publish_date_invalid", "currency_missing", "amount_equal", "period_invalid", "not_a_value", "other")


@query("a25_validation_cascade", "WITH r AS (SELECT list_extract(['forbidden_context','bid_end_before_start','publish_date_invalid','currency_missing','amount_equal','period_invalid','not_a_value','other'], (l_partkey % 8 + 1)::INT) AS rule FROM lineitem) SELECT CASE WHEN contains(rule, 'context') THEN 'context' WHEN contains(rule, 'date') THEN 'date' WHEN contains(rule, 'currency') OR contains(rule, 'amount') THEN 'amount' WHEN contains(rule, 'period') THEN 'period' WHEN contains(rule, 'bid_') OR contains(rule, 'not_') THEN 'logic' ELSE 'none' END AS rejected_by, count(*) AS n FROM r GROUP BY 1")
def a25(spark, d):
    """Rejections by what their rule's name holds, each counted once by the first that fits."""
    rule = F.element_at(F.array(*map(F.lit, RULE_NAMES)), (F.col("l_partkey") % 8 + 1).cast("int"))
    has = lambda *words: functools.reduce(lambda a, b: a | b, [F.contains("rule", F.lit(w)) for w in words])
    by = F.when(has("context"), "context").when(has("date"), "date").when(has("currency", "amount"), "amount").when(has("period"), "period").when(has("bid_", "not_"), "logic").otherwise("none")
    return domain.table(spark, d, "lineitem").select(rule.alias("rule")).groupBy(by.alias("rejected_by")).agg(F.count("*").alias("n"))


@query("a26_document_summary", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY 1")
def a26(spark, d):
    return domain.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), agg.count_if(F.col("lang") == "en").alias("english"))


@query("a27_sequence_numbers", "SELECT o_orderkey, strftime(o_orderdate, 'FIN-%Y%m%d-') || lpad(CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS VARCHAR), 4, '0') AS number FROM orders")
def a27(spark, d):
    o = domain.table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    got = ranking.numbered(o, ["day"], [F.col("o_orderkey")], "k")
    return got.select("o_orderkey", F.concat(F.lit("FIN-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("number"))


@query("r30_quick_insights", with_("finance") + f", k AS (SELECT count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Missing') AS missing, count(*) FILTER ({DAYS_SQL.format('expiry_date')} BETWEEN 0 AND 30) AS expiring FROM finance) SELECT * FROM (SELECT 'pending' AS insight, pending AS value FROM k UNION ALL SELECT 'missing', missing FROM k UNION ALL SELECT 'expiring', expiring FROM k) WHERE value > 0")
def r30(spark, d):
    days = dates.days_until(F.col("expiry_date"), as_of())
    k = domain.finance_records(spark, d).agg(agg.count_if(F.col("status") == "Pending").alias("pending"), agg.count_if(F.col("status") == "Missing").alias("missing"), agg.count_if(days.between(0, 30)).alias("expiring"))
    return k.select(F.expr("stack(3, 'pending', pending, 'missing', missing, 'expiring', expiring) as (insight, value)")).where("value > 0")


# feeds, alerts and pages -----------------------------------------------------------------------------------------


@query("s01_activity_feed", "SELECT 'purchase' AS kind, event_id AS id, ts AS happened FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'signup', event_id, ts FROM events WHERE event_type = 'signup' UNION ALL SELECT 'tender', o_orderkey, o_orderdate FROM orders")
def s01(spark, d):
    log = domain.logs(spark, d)
    part = lambda kind: log.where(F.col("action") == kind).select(F.lit(kind).alias("kind"), F.col("log_id").alias("id"), F.col("created_at").alias("happened"))
    t = domain.tenders(spark, d).select(F.lit("tender").alias("kind"), F.col("tender_id").alias("id"), F.col("updated_at").alias("happened"))
    return part("purchase").unionByName(part("signup")).unionByName(t)


@query("s02_al05_critical_feed", with_("finance", "contracts") + f", a AS (SELECT 'finance' AS source, record_id AS id, {DAYS_SQL.format('expiry_date')} AS days FROM finance WHERE status = 'Active' UNION ALL SELECT 'contract', tender_id, {DAYS_SQL.format('contract_end')} FROM contracts) SELECT source, {PRIORITY_SQL.format('days')} AS priority, count(*) AS n, min(days) AS nearest FROM a WHERE days <= 30 GROUP BY 1, 2")
def s02(spark, d):
    f = domain.finance_records(spark, d).where("status = 'Active'").select(F.lit("finance").alias("source"), F.col("record_id").alias("id"), dates.days_until(F.col("expiry_date"), as_of()).alias("days"))
    c = domain.contracts(spark, d).select(F.lit("contract").alias("source"), F.col("tender_id").alias("id"), dates.days_until(F.col("contract_end"), as_of()).alias("days"))
    return f.unionByName(c).where("days <= 30").groupBy("source", dates.alert_priority(F.col("days")).alias("priority")).agg(F.count("*").alias("n"), F.min("days").alias("nearest"))


@query("l01_page", with_("tenders") + "SELECT tender_id, status, estimated_value FROM tenders ORDER BY estimated_value DESC, tender_id LIMIT 20 OFFSET 40")
def l01(spark, d):
    return paging.page(domain.tenders(spark, d).select("tender_id", "status", "estimated_value"), [F.col("estimated_value").desc(), F.col("tender_id")], 3, 20)


@query("l01_page_count", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM orders")
def l01_count(spark, d):
    return paging.page_count(domain.tenders(spark, d), 20)


@query("l02_page_unclamped", with_("tenders") + "SELECT tender_id, updated_at FROM tenders ORDER BY updated_at DESC, tender_id LIMIT 250")
def l02(spark, d):
    return paging.page(domain.tenders(spark, d).select("tender_id", "updated_at"), [F.col("updated_at").desc(), F.col("tender_id")], 1, 250, clamp=False)


@query("l03_merged_top", "SELECT * FROM (SELECT * FROM (SELECT event_type AS kind, event_id AS id, ts AS happened FROM events WHERE event_type = 'click' ORDER BY happened DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT event_type, event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 10) UNION ALL SELECT * FROM (SELECT event_type, event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10)) ORDER BY happened DESC, id LIMIT 30")
def l03(spark, d):
    log = domain.logs(spark, d).select(F.col("action").alias("kind"), F.col("log_id").alias("id"), F.col("created_at").alias("happened"))
    return paging.merged_top([log.where(F.col("kind") == k) for k in ("click", "view", "error")], [F.col("happened").desc(), F.col("id")], 30)


@query("l04_severity_order", with_("finance") + f", a AS (SELECT record_id, {DAYS_SQL.format('expiry_date')} AS days FROM finance WHERE status = 'Active') SELECT record_id, {PRIORITY_SQL.format('days')} AS priority, days FROM a ORDER BY CASE WHEN days <= 7 THEN 0 WHEN days <= 15 THEN 1 WHEN days <= 30 THEN 2 ELSE 3 END, days DESC, record_id LIMIT 25")
def l04(spark, d):
    days = dates.days_until(F.col("expiry_date"), as_of())
    f = domain.finance_records(spark, d).where("status = 'Active'").select("record_id", dates.alert_priority(days).alias("priority"), days.alias("days"))
    return paging.page(f, [paging.severity(F.col("priority")), F.col("days").desc(), F.col("record_id")], 1, 25)


@query("l05_alphabetic_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def l05(spark, d):
    return paging.page(domain.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), [F.col("o_orderpriority"), F.col("o_orderkey")], 1, 100)


@query("l07_top_category", with_("classifications") + f"SELECT {LABEL_SQL} AS category, count(*) AS n FROM classifications GROUP BY 1 ORDER BY n DESC, category LIMIT 1")
def l07(spark, d):
    counts = domain.classifications(spark, d).groupBy(filters.category_label(F.col("service_category")).alias("category")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(1)


@query("al01_expiry_alerts", with_("finance") + f", a AS (SELECT record_id, {DAYS_SQL.format('expiry_date')} AS days FROM finance WHERE record_type IN ('BG','PBG') AND status <> 'Refunded') SELECT record_id, days, CASE WHEN days < 0 THEN 'expired' WHEN days <= 7 THEN '7_days' WHEN days <= 15 THEN '15_days' ELSE '30_days' END AS level, CASE WHEN days < 0 THEN 'expired' ELSE '30_days' END AS compat_level FROM a WHERE days <= 30")
def al01(spark, d):
    days = dates.days_until(F.col("expiry_date"), as_of())
    f = domain.finance_records(spark, d).where("record_type in ('BG', 'PBG') and status <> 'Refunded'").select("record_id", days.alias("days"))
    return f.withColumns({"level": dates.expiry_level(F.col("days")), "compat_level": dates.expiry_level(F.col("days"), compat=True)}).where("level is not null")


RULES = (("contract_expiry", 0, "critical"), ("contract_expiry", 7, "critical"), ("contract_expiry", 30, "high"), ("amc_expiry", 7, "critical"), ("amc_expiry", 30, "high"), ("agreement_expiry", 15, "high"))


@query("al02_rule_alerts", with_("contracts") + f""", r AS (SELECT * FROM (VALUES ('contract_expiry', 0, 'critical', 0), ('contract_expiry', 7, 'critical', 1), ('contract_expiry', 30, 'high', 2), ('amc_expiry', 7, 'critical', 3), ('amc_expiry', 30, 'high', 4), ('agreement_expiry', 15, 'high', 5)) v(kind, n, priority, k)),
    d AS (SELECT tender_id, 'contract_expiry' AS kind, contract_end AS due FROM contracts UNION ALL SELECT tender_id, 'amc_expiry', contract_end - INTERVAL 45 DAY FROM contracts UNION ALL SELECT tender_id, 'agreement_expiry', contract_end - INTERVAL 20 DAY FROM contracts),
    x AS (SELECT tender_id, kind, {DAYS_SQL.format('due')} AS days FROM d)
    SELECT tender_id, x.kind, days, priority FROM x JOIN r ON x.kind = r.kind AND (n = 0 AND days < 0 OR n > 0 AND days BETWEEN 0 AND n) QUALIFY row_number() OVER (PARTITION BY tender_id, x.kind ORDER BY k) = 1
    UNION ALL SELECT tender_id, 'revenue_delay', NULL, 'medium' FROM contracts WHERE tender_id % 4 = 0 AND contract_end < {TS} UNION ALL SELECT tender_id, 'pending_billing', NULL, 'medium' FROM contracts WHERE tender_id % 8 = 0""")
def al02(spark, d):
    """Dates of contracts against the rules, the first rule that fits; overdue revenue and open billing beside them.

    A rule of 0 days fits dates that are past. Every fourth contract's revenue is pending here, overdue once it has ended; every eighth's billing is open.
    """
    end = F.col("contract_end")
    due = {"contract_expiry": end, "amc_expiry": end - F.expr("interval 45 days"), "agreement_expiry": end - F.expr("interval 20 days")}

    def alert(kind: str, days, priority):
        return F.struct(F.lit(kind).alias("kind"), days.cast("long").alias("days"), priority.alias("priority"))

    def dated(kind: str):
        days, found = dates.days_until(due[kind], as_of()), F.lit(None).cast("string")
        for _, n, priority in reversed([r for r in RULES if r[0] == kind]):
            found = F.when((days < 0) if n == 0 else days.between(0, n), priority).otherwise(found)
        return alert(kind, days, found)

    state = lambda condition, kind: alert(kind, F.lit(None), F.when(condition, "medium"))
    late, open_ = (F.col("tender_id") % 4 == 0) & (end < as_of()), F.col("tender_id") % 8 == 0
    # all alerts of a contract at once, so contracts are summed up from their lines once
    alerts = F.array(*map(dated, due), state(late, "revenue_delay"), state(open_, "pending_billing"))
    rows = domain.contracts(spark, d).select("tender_id", "contract_end").select("tender_id", F.explode(alerts).alias("a"))
    return rows.select("tender_id", "a.*").where("priority is not null")


@query("al04_new_levels", """WITH x AS (SELECT user_id, event_id, ts, CASE WHEN us < 0 THEN 'expired' WHEN us <= 3600000000 THEN '1_hour' WHEN us <= 6 * 3600000000 THEN '6_hours' WHEN us <= 24 * 3600000000 THEN '24_hours' WHEN us <= 72 * 3600000000 THEN '3_days' WHEN us <= 168 * 3600000000 THEN '7_days' END AS level
    FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) AS us FROM events)) SELECT user_id, event_id, level FROM (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM x WHERE level IS NOT NULL) WHERE level IS DISTINCT FROM last""")
def al04_new(spark, d):
    """Deadline alerts that are sent: those whose level is not the last one sent for the same key. Events stand for checks of a deadline."""
    log = domain.logs(spark, d)
    level = dates.submission_level(F.lit("2024-01-20").cast("timestamp"), F.col("created_at"))
    rows = log.select("user_id", F.col("log_id").alias("event_id"), "created_at", level.alias("level")).where("level is not null")
    return ranking.changed(rows, ["user_id"], [F.col("created_at"), F.col("event_id")], "level").select("user_id", "event_id", "level")


@query("al05_critical_alerts", with_("finance", "contracts", "tenders") + f""", f AS (SELECT 'finance' AS source, record_id AS id, {DAYS_SQL.format('expiry_date')} AS days FROM finance WHERE record_type IN ('BG', 'PBG') AND status = 'Active' ORDER BY days, id LIMIT 30), p AS (SELECT 'post_award', tender_id, {DAYS_SQL.format('contract_end')} AS days FROM contracts WHERE {DAYS_SQL.format('contract_end')} BETWEEN 0 AND 30 ORDER BY days, tender_id LIMIT 30),
    s AS (SELECT 'submission', tender_id, {DAYS_SQL.format('updated_at')} AS days FROM tenders WHERE status <> 'SUBMITTED' AND updated_at BETWEEN {TS} AND {TS} + INTERVAL 14 DAY ORDER BY days, tender_id LIMIT 20), r AS (SELECT 'refund', record_id, NULL::BIGINT AS days FROM finance WHERE refund_status = 'pending' ORDER BY record_id LIMIT 10),
    u AS (SELECT * FROM f UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r), q AS (SELECT *, CASE source WHEN 'finance' THEN CASE WHEN days <= 7 THEN 'critical' WHEN days <= 15 THEN 'high' ELSE 'medium' END WHEN 'post_award' THEN CASE WHEN days <= 7 THEN 'critical' ELSE 'high' END WHEN 'submission' THEN CASE WHEN days <= 3 THEN 'critical' ELSE 'high' END ELSE 'high' END AS priority FROM u)
    SELECT source, id, priority FROM q ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, source, id LIMIT 25""")
def al05(spark, d):
    """Four sources of alerts, each its first ones, then the 25 most severe of all."""
    until = lambda x: dates.days_until(F.col(x), as_of())
    finance = domain.finance_records(spark, d)
    source = lambda rows, name, key, days, most: rows.select(F.lit(name).alias("source"), F.col(key).alias("id"), days.alias("days")).orderBy("days", "id").limit(most)
    guarantees = source(finance.where("record_type in ('BG', 'PBG') and status = 'Active'"), "finance", "record_id", until("expiry_date"), 30)
    contracts = source(domain.contracts(spark, d).where(until("contract_end").between(0, 30)), "post_award", "tender_id", until("contract_end"), 30)
    near = filters.not_equal(F.col("status"), "SUBMITTED") & F.col("updated_at").between(as_of(), as_of() + F.expr("interval 14 days"))
    deadlines = source(domain.tenders(spark, d).where(near), "submission", "tender_id", until("updated_at"), 20)
    refunds = source(finance.where("refund_status = 'pending'"), "refund", "record_id", F.lit(None).cast("long"), 10)
    every = guarantees.unionByName(contracts).unionByName(deadlines).unionByName(refunds)
    is_, days = (lambda name: F.col("source") == name), F.col("days")
    urgent = F.when(is_("finance"), F.when(days <= 7, "critical").when(days <= 15, "high").otherwise("medium")).when(is_("post_award"), F.when(days <= 7, "critical").otherwise("high"))
    priority = urgent.when(is_("submission"), F.when(days <= 3, "critical").otherwise("high")).otherwise("high")
    order = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).otherwise(2)
    return every.select("source", "id", priority.alias("priority")).orderBy(order, "source", "id").limit(25)


@query("al04_d05_deadlines", f"""WITH x AS (SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00') AS us FROM events), y AS (SELECT event_id, us, CAST(floor(us / 60000000.0) AS BIGINT) AS m FROM x)
    SELECT event_id, CASE WHEN m < 0 THEN 'Expired' WHEN m // 1440 > 0 THEN (m // 1440) || 'd ' || (m // 60 % 24) || 'h' WHEN m // 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS label,
    CASE WHEN us < 0 THEN 'expired' WHEN us <= 3600000000 THEN '1_hour' WHEN us <= 6 * 3600000000 THEN '6_hours' WHEN us <= 24 * 3600000000 THEN '24_hours' WHEN us <= 72 * 3600000000 THEN '3_days' WHEN us <= 168 * 3600000000 THEN '7_days' END AS level FROM y""")
def al04(spark, d):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return domain.logs(spark, d).select(F.col("log_id").alias("event_id"), dates.countdown(F.col("created_at"), now).alias("label"), dates.submission_level(F.col("created_at"), now).alias("level"))
