"""Rule scoring over notices and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dates, money, rules
from quillon.operators import aggregates as agg
from quillon.plans.registry import query
from quillon.sources import notices as n
from quillon.sources.domain import AS_OF, table
from quillon.sources.notices import with_

c = F.col
#: The bidder that the eligibility and risk queries judge for.
COMPANY = {"turnover": 50_000_000.0, "years": 5, "msme": False, "gst": True, "pan": True, "iso": False}
#: Profiles with heading patterns, for the second classifier.
PROFILES = (
    ("Service Tender", ("housekeeping", "security guard", "manpower", "watch and ward"), (r"(?i)notice\s+inviting\s+tender",)),
    ("Works Tender", ("civil works", "road work", "construction", "completion period"), (r"(?i)invitation\s+to\s+bid",)),
    ("Goods Tender", ("supply of", "hardware", "make and model"), (r"(?i)tender\s+notice", r"(?i)oem")),
    ("Transport Tender", ("vehicle hire", "fleet"), ()),
)


def _weight(keyword: str) -> int:
    return (2, 3, 5)[min(3, len(keyword.split())) - 1]


def _classify_sql(kb, base, step, cap, floor) -> str:
    words = ", ".join(f"({k}, '{name}', '{w}', {_weight(w)}, {str(' ' in w).lower()})" for k, (name, ws, *_) in enumerate(kb) for w in ws)
    patterns = [f"({k}, '{p}')" for k, (_, _, *ps) in enumerate(kb) for p in (ps[0] if ps else ())]
    extra = f"UNION ALL SELECT notice_id, p.k, 3 FROM notices, (VALUES {', '.join(patterns)}) AS p(k, p) WHERE regexp_matches(text, p.p)" if patterns else ""
    names = ", ".join(f"({k}, '{name}')" for k, (name, *_) in enumerate(kb))
    return (
        with_("notices") + f"""SELECT notice_id, coalesce(max(CASE WHEN r = 1 AND s > 0 THEN name END), '') AS name, max(CASE WHEN r = 1 THEN s END)::INT AS score,
        CASE WHEN max(s) > 0 THEN least(99, greatest({floor}, {base} + {step} * (max(CASE WHEN r = 1 THEN s END) - max(CASE WHEN r = 2 THEN s END)) + least(max(s), {cap}))) ELSE 0 END::INT AS confidence
        FROM (SELECT notice_id, g.name, coalesce(sum(s), 0) AS s, row_number() OVER (PARTITION BY notice_id ORDER BY coalesce(sum(s), 0) DESC, g.k) AS r
        FROM (SELECT notice_id, g.k, g.name FROM notices, (VALUES {names}) AS g(k, name)) g LEFT JOIN (
        SELECT notice_id AS id, k, w.weight * CASE WHEN w.phrase THEN (length(t) - length(replace(t, w.w, ''))) / length(w.w) ELSE len(regexp_extract_all(t, '\\b' || w.w || '\\b')) END AS s
        FROM (SELECT notice_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM notices), (VALUES {words}) AS w(k, name, w, weight, phrase) {extra}) h ON h.id = g.notice_id AND h.k = g.k GROUP BY notice_id, g.k, g.name) GROUP BY 1"""
    )


@query("r01_service_classification", _classify_sql(rules.SERVICES, 55, 4, 20, 40))
def r01(spark, d):
    return rules.service_class(n.notices(spark, d), "text").select("notice_id", "k.name", "k.score", "k.confidence")


@query("r02_tender_type", _classify_sql(PROFILES, 50, 3, 25, 35))
def r02(spark, d):
    return rules.profile_class(n.notices(spark, d), "text", PROFILES).select("notice_id", "k.name", "k.score", "k.confidence")


LOW = "page % 11 = 0"
CORE = "regexp_matches(parameter, '(?i)\\b(tender value|emd|completion period|scope of work)')"


@query("r07_page_priority", with_("candidates") + f"""SELECT candidate_id, b AS page_priority, CASE WHEN NOT {CORE} THEN b WHEN page <= 5 AND NOT {LOW} THEN least(100, b + 10) ELSE greatest(10, b - 30) END AS candidate_priority
    FROM (SELECT *, CASE WHEN {LOW} THEN 10 WHEN page <= 5 THEN 100 WHEN page <= 20 THEN 70 ELSE 40 END AS b FROM candidates)""")
def r07(spark, d):
    low = F.expr(LOW)
    return n.candidates(spark, d).select("candidate_id", rules.page_priority(c("page"), low).alias("page_priority"), rules.candidate_page_priority(c("page"), c("parameter"), low).alias("candidate_priority"))


@query("r08_additive_rank", with_("candidates") + f"""SELECT candidate_id, page_score, validation_score, page_score + section_score + alias_score + type_score + validation_score + source_score + verification_score AS total FROM (SELECT candidate_id,
    CASE WHEN {LOW} THEN 0 WHEN page <= 5 THEN 30 WHEN page <= 20 THEN 20 ELSE 10 END AS page_score, CASE section_match WHEN 'primary' THEN 25 WHEN 'fallback' THEN 10 ELSE 0 END AS section_score,
    CASE WHEN NOT alias_mapped AND parameter = 'EMD Amount' THEN 20 WHEN alias_mapped AND alias_score >= 80 THEN 15 ELSE 5 END AS alias_score, CASE WHEN type_match THEN 15 ELSE 0 END AS type_score,
    CASE validation WHEN 'VALID' THEN 30 WHEN 'REVIEW' THEN 10 ELSE 0 END AS validation_score, CASE source WHEN 'AI+RULE' THEN 25 WHEN 'RULE' THEN 15 ELSE 10 END AS source_score,
    least(10, CAST(floor(confidence / 10.0 + 0.5) AS INT)) AS verification_score FROM candidates)""")
def r08(spark, d):
    rank = rules.additive_rank(c("page"), F.expr(LOW), c("section_match"), c("alias_mapped"), c("alias_score"), c("parameter") == "EMD Amount", c("type_match"), c("validation"), c("source"), c("confidence"))
    return n.candidates(spark, d).select("candidate_id", rank.alias("r")).select("candidate_id", "r.page_score", "r.validation_score", "r.total")


@query("r12_confidence_bands", with_("candidates") + """, v AS (SELECT *, validation = 'VALID' AS ok, correctness <> 'incorrect' AND coalesce(ai_confidence, 0) >= 70 AND value <> '' AS ver, (coalesce(ai_confidence, 70) - 70) / 30.0 AS up FROM candidates),
    b AS (SELECT *, CASE WHEN ok IS NOT NULL AND NOT ok THEN 'invalid' WHEN method = 'ai_inferred' THEN 'inferred' WHEN method = 'exact' AND ok AND ver THEN 'exact verified' WHEN method = 'regex' AND ok AND ver THEN 'regex verified'
    WHEN method = 'alias' AND ok AND ver THEN 'alias verified' WHEN method = 'fuzzy' AND ok AND ver THEN 'fuzzy verified' WHEN method = 'fuzzy' AND ok THEN 'fuzzy validated' WHEN method = 'exact' AND ok THEN 'exact validated'
    WHEN method = 'regex' AND ok THEN 'regex validated' WHEN method = 'alias' AND ok THEN 'alias validated' WHEN method = 'fuzzy' THEN 'fuzzy' WHEN ok AND ver THEN 'validated verified' WHEN ok THEN 'validated' ELSE 'unvalidated' END AS band FROM v),
    s AS (SELECT *, CASE band WHEN 'invalid' THEN least(35, greatest(0, floor(15 + coalesce(ai_confidence, 0) * 0.15 + 0.5))) WHEN 'inferred' THEN least(75, greatest(60, floor(60 + (coalesce(ai_confidence, 55) - 50) / 50.0 * 15 + 0.5)))
    WHEN 'exact verified' THEN least(100, greatest(95, floor(95.5 + up * 5))) WHEN 'regex verified' THEN least(95, greatest(90, floor(90.5 + up * 5))) WHEN 'alias verified' THEN least(90, greatest(85, floor(85.5 + up * 5)))
    WHEN 'fuzzy verified' THEN least(85, greatest(75, floor(80.5 + up * 5))) WHEN 'fuzzy validated' THEN 78 WHEN 'exact validated' THEN 90 WHEN 'regex validated' THEN 85 WHEN 'alias validated' THEN 81 WHEN 'fuzzy' THEN 68
    WHEN 'validated verified' THEN least(88, greatest(80, floor(80.5 + up * 8))) WHEN 'validated' THEN 74 ELSE 50 END AS s0 FROM b), t AS (SELECT *, CASE WHEN page BETWEEN 1 AND 3 AND s0 < 100 THEN least(100, s0 + 2) ELSE s0 END AS s1 FROM s)
    SELECT candidate_id, band, CASE WHEN trim(value) = '' THEN 0 WHEN correctness = 'uncertain' AND s1 > 70 THEN s1 - 8 ELSE s1 END::INT AS confidence FROM t""")
def r12(spark, d):
    got = rules.band_confidence(c("method"), c("validation") == "VALID", c("ai_confidence"), c("correctness"), c("value"), c("page"))
    return n.candidates(spark, d).select("candidate_id", got.alias("b")).select("candidate_id", "b.band", "b.confidence")


@query("r13_validation_confidence", with_("candidates") + """SELECT candidate_id, least(100, CASE WHEN page <= 20 THEN 30 ELSE 15 END + CASE section_match WHEN 'primary' THEN 25 WHEN 'fallback' THEN 12 ELSE 0 END + CASE WHEN NOT alias_mapped THEN 0 WHEN alias_score >= 80 THEN 15 ELSE 8 END
    + CASE validation WHEN 'VALID' THEN 20 WHEN 'REVIEW' THEN 8 ELSE 0 END + CASE WHEN type_match THEN 20 ELSE 0 END) AS confidence FROM candidates""")
def r13(spark, d):
    priority = rules.page_priority(c("page"), F.lit(False))
    return n.candidates(spark, d).select("candidate_id", rules.validation_confidence(priority, c("section_match"), c("alias_mapped"), c("alias_score"), c("validation"), c("type_match")).alias("confidence"))


@query("r14_layered_validation", with_("candidates") + """, x AS (SELECT *, count(DISTINCT page) OVER (PARTITION BY notice_id, parameter, value) AS pages FROM candidates), y AS (SELECT candidate_id, CASE WHEN validation = 'REJECT' OR value = '' THEN 'REJECT' WHEN validation = 'REVIEW' OR
    section_match = 'none' THEN 'REVIEW' ELSE 'VALID' END AS status, least(100, floor(confidence + 0.5 * CASE WHEN pages >= 2 THEN least(15, 5 * pages) ELSE 0 END + 0.1 * alias_score + 0.5)) AS kept FROM x)
    SELECT candidate_id, status, CASE WHEN status = 'REJECT' THEN floor(kept * 0.4 + 0.5) ELSE kept END::INT AS confidence FROM y""")
def r14(spark, d):
    rows = n.candidates(spark, d)
    # the cross layer: how many pages bear a value out, counted before it is joined back
    same = ["notice_id", "parameter", "value"]
    repeats = rows.groupBy(*same).agg(F.countDistinct("page").alias("pages"))
    layers = [F.coalesce(c("validation"), F.lit("VALID")), F.when(c("value") == "", "REJECT").otherwise("VALID"), F.when(c("section_match") == "none", "REVIEW").otherwise("VALID")]
    return rows.join(repeats, same).select("candidate_id", rules.layered_status(layers, c("alias_score"), c("confidence"), c("pages")).alias("r")).select("candidate_id", "r.status", "r.confidence")


AMOUNT_SQL = """(CAST(nullif(regexp_extract({0}, '(\\d[\\d,]*(?:\\.\\d+)?|\\.\\d+)', 1), '') AS DOUBLE) * CASE WHEN regexp_matches({0}, '(?i)\\d\\s*(crores?|cr)\\b') THEN 1e7 WHEN regexp_matches({0}, '(?i)\\d\\s*(lakhs?|lacs?|l)\\b') THEN 1e5 ELSE 1.0 END)"""


@query("r16_field_validators", with_("fields") + f""", p AS (SELECT *, right(regexp_replace(phone, '\\D', '', 'g'), 10) AS ten, {AMOUNT_SQL.format('emd_amount')} AS a, regexp_extract(tender_no, '([A-Za-z0-9][A-Za-z0-9/\\-_.]{{4,50}})', 1) AS num FROM fields)
    SELECT notice_id, CASE WHEN emd_amount = 'Nil' THEN '0' WHEN a > 0 THEN CAST(CAST(floor(a + 0.5) AS BIGINT) AS VARCHAR) END AS currency, CASE WHEN emd_amount <> 'Nil' AND (a IS NULL OR a <= 0) THEN 'not_an_amount' END AS currency_reason, lower(contact) AS email,
    CASE WHEN regexp_matches(ten, '^[6-9]\\d{{9}}$') THEN ten END AS phone, CASE WHEN length(ten) <> 10 THEN 'not_ten_digits' WHEN NOT regexp_matches(ten, '^[6-9]') THEN 'not_a_mobile_number' END AS phone_reason, nullif(num, '') AS tender_number FROM p""")
def r16(spark, d):
    f = n.fields(spark, d).select(
        "notice_id", rules.valid_currency(c("emd_amount")).alias("a"), rules.valid_email(c("contact")).alias("e"), rules.valid_phone(c("phone")).alias("p"), rules.valid_tender_number(c("tender_no")).alias("t")
    )
    return f.select("notice_id", c("a.value").alias("currency"), c("a.reason").alias("currency_reason"), c("e.value").alias("email"), c("p.value").alias("phone"), c("p.reason").alias("phone_reason"), c("t.value").alias("tender_number"))


@query("r17_master_field_rules", with_("fields") + """SELECT notice_id, CASE WHEN contains(lower(tender_no), '/1997') THEN 'rejected_phrase' END AS number_reason, CASE WHEN trim(certificates) = '' THEN 'empty' WHEN contains(lower(certificates), 'dealer') THEN 'rejected_phrase' END AS name_reason FROM fields""")
def r17(spark, d):
    return n.fields(spark, d).select("notice_id", rules.valid_master_value(F.lit("tenderNumber"), c("tender_no"), ("/1997",)).alias("number_reason"), rules.valid_master_value(F.lit("organization"), c("certificates"), (), ("dealer",)).alias("name_reason"))


def _checks(f, spelled: bool):
    """The nine checks of a notice for the company, as columns; ``spelled``: as the second engine words them."""
    required = F.coalesce(money.parse_amount(f["turnover"]), F.lit(0.0))
    deposit = F.coalesce(money.parse_amount(f["emd_amount"]), F.lit(0.0))
    certificates, limit = f["certificates"], COMPANY["turnover"] * 0.05
    asks = lambda pattern: certificates.rlike(f"(?i){pattern}")
    return [
        (required == 0) | (required <= COMPANY["turnover"]), dates.experience_years(f["experience"]) <= COMPANY["years"], ~asks("oem|authorized|manufacturer"),
        deposit <= limit if spelled else deposit < limit, ~asks("msme|mii|preference" if spelled else r"msme|udyam|small\s*enterprise") | F.lit(COMPANY["msme"]),
        ~asks("gst") | F.lit(COMPANY["gst"]), ~asks("pan") | F.lit(COMPANY["pan"]), ~asks("iso") | F.lit(COMPANY["iso"]), F.lit(True),
    ]


def _eligibility_sql(weights, spelled):
    t, msme = COMPANY["turnover"], "msme|mii|preference" if spelled else "msme|udyam|small\\s*enterprise"
    tests = [
        f"coalesce({AMOUNT_SQL.format('turnover')}, 0) <= {t}", f"CAST(regexp_extract(experience, '(\\d+)', 1) AS INT) <= {COMPANY['years']}", "NOT regexp_matches(certificates, '(?i)oem|authorized|manufacturer')",
        f"coalesce({AMOUNT_SQL.format('emd_amount')}, 0) {'<=' if spelled else '<'} {t * 0.05}", f"NOT regexp_matches(certificates, '(?i){msme}')", "true", "true", "NOT regexp_matches(certificates, '(?i)iso')", "true"]
    score = " + ".join(f"CASE WHEN {x} THEN {w} ELSE 0 END" for x, w in zip(tests, weights))
    count = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in tests)
    status = "CASE WHEN n_passed = 9 THEN 'ELIGIBLE' WHEN n_passed >= 5.4 THEN 'PARTIALLY_ELIGIBLE' ELSE 'NOT_ELIGIBLE' END" if spelled else "CASE WHEN score >= 80 AND n_passed >= 8 THEN 'ELIGIBLE' WHEN score >= 50 THEN 'PARTIALLY_ELIGIBLE' ELSE 'NOT_ELIGIBLE' END"
    return with_("fields") + f", e AS (SELECT notice_id, CAST(floor(({score}) * 100.0 / {sum(weights)} + 0.5) AS INT) AS score, {count} AS n_passed, emd_amount, estimated_cost FROM fields) SELECT notice_id, score, n_passed, {status} AS status"


@query("r20_eligibility", _eligibility_sql(rules.WEIGHTS_A, False) + f""", CAST(greatest(0, floor(greatest(0, score - 3) - CASE WHEN {AMOUNT_SQL.format('emd_amount')} > 0 AND {AMOUNT_SQL.format('estimated_cost')} > 0 AND {AMOUNT_SQL.format('emd_amount')} / {AMOUNT_SQL.format('estimated_cost')} > 0.05 THEN 5 ELSE 0 END + 0.5)) AS INT) AS adjusted FROM e""")
def r20(spark, d):
    f = n.fields(spark, d)
    rows = f.select("notice_id", rules.eligibility(_checks(f, False), rules.WEIGHTS_A, False).alias("e"), money.parse_amount(f["emd_amount"]).alias("deposit"), money.parse_amount(f["estimated_cost"]).alias("cost"))
    return rows.select("notice_id", "e.score", "e.n_passed", "e.status", rules.adjusted_eligibility(c("e.score"), F.lit(3), c("deposit"), c("cost")).alias("adjusted"))


@query("r21_eligibility_strict", _eligibility_sql(rules.WEIGHTS_B, True) + " FROM e")
def r21(spark, d):
    f = n.fields(spark, d)
    return f.select("notice_id", rules.eligibility(_checks(f, True), rules.WEIGHTS_B, True).alias("e")).select("notice_id", "e.score", "e.n_passed", "e.status")


def _risks(f):
    """The five risk levels of a notice; phone stands for the performance security, contact for manpower."""
    days = F.datediff(F.to_date(dates.normalize_date(f["last_date"])["value"]), F.lit("1997-06-01").cast("date"))
    some = lambda x: F.trim(f[x]) != ""
    return {
        "financial": rules.financial_risk(f["emd_amount"], f["estimated_cost"], F.when(c("notice_id") % 7 != 0, f["phone"]), f["completion_period"], COMPANY["turnover"]),
        "technical": rules.technical_risk(f["name_of_work"], f["certificates"], F.lit("")),
        "eligibility": rules.eligibility_risk(money.parse_amount(f["turnover"]), dates.experience_years(f["experience"]), some("turnover"), COMPANY["turnover"], COMPANY["years"]),
        "timeline": rules.timeline_risk(days, F.lit(True), some("completion_period"), f["completion_period"]),
        "compliance": rules.compliance_risk(f["certificates"], F.when(c("notice_id") % 7 != 0, f["phone"]), COMPANY["iso"], COMPANY["gst"]),
    }


RISK_SQL = with_("fields") + f""", r AS (SELECT notice_id,
    CASE WHEN coalesce({AMOUNT_SQL.format('emd_amount')}, 0) > 2500000 THEN 'HIGH' WHEN notice_id % 7 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS financial,
    CASE WHEN regexp_matches(name_of_work, '(?i)cctv|turnkey') OR trim(certificates) = '' THEN 'MEDIUM' ELSE 'LOW' END AS technical,
    CASE WHEN coalesce({AMOUNT_SQL.format('turnover')}, 0) > 50000000 OR notice_id % 9 > 5 THEN 'HIGH' ELSE 'LOW' END AS eligibility,
    CASE WHEN days BETWEEN 0 AND 7 THEN 'HIGH' WHEN days BETWEEN 8 AND 14 OR completion_period = '90 days only' THEN 'MEDIUM' ELSE 'LOW' END AS timeline,
    CASE WHEN (trim(certificates) = '')::INT + (notice_id % 7 = 0)::INT + regexp_matches(certificates, '(?i)iso 9001')::INT >= 2 OR regexp_matches(certificates, '(?i)iso 9001') THEN 'HIGH'
    WHEN trim(certificates) = '' OR notice_id % 7 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS compliance
    FROM (SELECT f.*, date_diff('day', DATE '1997-06-01', CASE notice_id % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN make_date(year(o_orderdate), 3, 5) END) AS days FROM fields f JOIN orders ON o_orderkey = notice_id)),
    o AS (SELECT *, list_contains([financial, technical, eligibility, timeline, compliance], 'HIGH') AS h, list_contains([financial, technical, eligibility, timeline, compliance], 'MEDIUM') AS m FROM r) """


@query("r22_risk_levels", RISK_SQL + "SELECT notice_id, financial, technical, eligibility, timeline, compliance, CASE WHEN h THEN 'HIGH' WHEN m THEN 'MEDIUM' ELSE 'LOW' END AS overall FROM o")
def r22(spark, d):
    f = n.fields(spark, d)
    rows = f.select("notice_id", *[level.alias(name) for name, level in _risks(f).items()])
    return rows.withColumn("overall", rules.worst_level([c(x) for x in ("financial", "technical", "eligibility", "timeline", "compliance")]))


@query("r23_recommendation", RISK_SQL + """, q AS (SELECT *, CAST(floor(greatest(0, least(100, ((notice_id % 11) / 11.0 * 0.45 + (notice_id % 101) / 100.0 * 0.55 - least(0.3, (notice_id % 5) / 11.0 * 0.5)) * 100)) + 0.5) AS INT) AS quality, notice_id % 4 = 3 AS one,
    list_sum([(x = 'HIGH')::INT for x in [financial, technical, eligibility, timeline, compliance]]) AS n_high, list_sum([(x = 'MEDIUM')::INT for x in [financial, technical, eligibility, timeline, compliance]]) AS n_medium FROM o)
    SELECT notice_id, quality, CASE WHEN (one AND eligibility = 'HIGH') OR eligibility = 'HIGH' THEN 'Do Not Apply' WHEN quality < 55 OR one OR n_high >= 2 OR (h AND timeline = 'HIGH') OR notice_id % 6 >= 4 THEN 'Need Manual Review'
    WHEN (NOT h AND m) OR n_medium >= 2 OR notice_id % 6 >= 2 OR quality < 75 THEN 'Apply With Caution' ELSE 'Apply Immediately' END AS recommendation FROM q""")
def r23(spark, d):
    rows = r22(spark, d)
    levels = F.array("financial", "technical", "eligibility", "timeline", "compliance")
    of = lambda level: F.size(F.filter(levels, lambda x: x == level))
    quality = rules.data_quality(F.lit(11), c("notice_id") % 11, c("notice_id") % 101, c("notice_id") % 5)
    rows = rows.withColumns({"quality": quality, "n_high": of("HIGH"), "n_medium": of("MEDIUM")})
    got = rules.recommendation((c("notice_id") % 4 == 3).cast("int"), c("notice_id") % 6, c("quality"), c("overall"), c("eligibility"), c("financial"), c("timeline"), c("n_high"), c("n_medium"))
    return rows.select("notice_id", "quality", got.alias("recommendation"))


@query("r24_feasibility", """SELECT o_orderkey AS notice_id, CASE WHEN r >= 90 AND l = 0 AND k = 0 THEN 'Strongly Recommended' WHEN r >= 75 AND l <> 2 THEN 'Recommended' WHEN r >= 55 OR k <= 2 THEN 'Recommended With Conditions' WHEN h >= 2 OR k >= 3 THEN 'High Risk' ELSE 'Not Recommended' END AS recommendation
    FROM (SELECT o_orderkey, o_orderkey % 101 AS r, o_custkey % 3 AS l, o_custkey % 5 AS k, o_custkey % 4 AS h FROM orders)""")
def r24(spark, d):
    level = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (c("o_custkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(c("o_orderkey").alias("notice_id"), rules.feasibility(c("o_orderkey") % 101, level, c("o_custkey") % 5, c("o_custkey") % 4).alias("recommendation"))


# checklists: lines of an order as items of its checklist

ITEM = """SELECT l_orderkey AS notice_id, l_linenumber AS item, l_returnflag AS category, l_quantity > 10 AS required, l_discount >= 0.04 AS uploaded, l_tax >= 0.07 AS expired,
    CASE l_suppkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' END AS review, l_partkey % 4 = 0 AS marked, l_partkey % 3 = 0 AS critical FROM lineitem"""
STATUS = """CASE WHEN review = 'approved' THEN 'approved' WHEN review = 'rejected' THEN 'rejected' WHEN NOT required THEN 'optional' WHEN NOT uploaded AND NOT marked THEN 'missing' WHEN expired THEN 'expired'
    WHEN uploaded AND review = 'pending' THEN 'pending_review' ELSE 'uploaded' END"""


def items(spark, d):
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("notice_id"), c("l_linenumber").alias("item"), c("l_returnflag").alias("category"), (c("l_quantity") > 10).alias("required"), (c("l_discount") >= 0.04).alias("uploaded"), (c("l_tax") >= 0.07).alias("expired"),
        F.when(c("l_suppkey") % 5 == 0, "approved").when(c("l_suppkey") % 5 == 1, "rejected").when(c("l_suppkey") % 5 == 2, "pending").alias("review"), (c("l_partkey") % 4 == 0).alias("marked"), (c("l_partkey") % 3 == 0).alias("critical"))
    return rows.withColumn("status", rules.item_status(c("required"), c("uploaded"), c("expired"), c("review"), c("marked")))


@query("r26_item_status", f"SELECT notice_id, item, s AS status, CASE WHEN s = 'approved' THEN 'verified' WHEN s = 'uploaded' OR uploaded THEN 'uploaded' WHEN NOT required THEN 'optional' WHEN s = 'missing' THEN 'missing' ELSE 'required' END AS shown FROM (SELECT *, {STATUS} AS s FROM ({ITEM}))")
def r26(spark, d):
    return items(spark, d).select("notice_id", "item", "status", rules.display_status(c("required"), c("status"), c("uploaded")).alias("shown"))


@query("a19_checklist_categories", f"SELECT category, count(*) FILTER (required) AS required, count(*) FILTER (required AND (uploaded OR s = 'approved') AND NOT expired) AS completed, count(*) FILTER (required) - count(*) FILTER (required AND (uploaded OR s = 'approved') AND NOT expired) AS pending, CASE WHEN count(*) FILTER (required) = 0 THEN 100 ELSE floor(100.0 * count(*) FILTER (required AND (uploaded OR s = 'approved') AND NOT expired) / count(*) FILTER (required) + 0.5) END::INT AS compliance FROM (SELECT *, {STATUS} AS s FROM ({ITEM})) GROUP BY 1")
def a19(spark, d):
    done = c("required") & (c("uploaded") | (c("status") == "approved")) & ~c("expired")
    got = items(spark, d).groupBy("category").agg(agg.count_if(c("required")).alias("required"), agg.count_if(done).alias("completed"))
    share = F.when(c("required") == 0, 100).otherwise(rules.rounded(100 * c("completed") / c("required")))
    return got.select("category", "required", "completed", (c("required") - c("completed")).alias("pending"), share.cast("int").alias("compliance"))


@query("a20_checklist_readiness", f"""SELECT notice_id, required, optional, uploaded, missing, approved, rejected, pending_review, critical_missing, uploaded + approved AS completed, CASE WHEN required = 0 THEN 100 ELSE floor(100.0 * (uploaded + approved) / required + 0.5) END::INT AS readiness,
    CASE WHEN required = 0 THEN 100 ELSE floor(100.0 * uploaded / required + 0.5) END::INT AS readiness_once FROM (SELECT notice_id, count(*) FILTER (required) AS required, count(*) FILTER (NOT required) AS optional, count(*) FILTER (required AND (uploaded OR s = 'approved') AND NOT expired) AS uploaded,
    count(*) FILTER (required AND s = 'missing') AS missing, count(*) FILTER (s = 'approved') AS approved, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'pending_review') AS pending_review, count(*) FILTER (required AND critical AND s = 'missing') AS critical_missing FROM (SELECT *, {STATUS} AS s FROM ({ITEM})) GROUP BY 1)""")
def a20(spark, d):
    """Readiness counts approved items twice, as the reports that people know do; readiness_once counts each once."""
    is_ = lambda s: c("status") == s
    got = items(spark, d).groupBy("notice_id").agg(
        agg.count_if(c("required")).alias("required"), agg.count_if(~c("required")).alias("optional"), agg.count_if(c("required") & (c("uploaded") | is_("approved")) & ~c("expired")).alias("up"),
        agg.count_if(c("required") & is_("missing")).alias("missing"), agg.count_if(is_("approved")).alias("approved"), agg.count_if(is_("rejected")).alias("rejected"), agg.count_if(is_("pending_review")).alias("pending_review"),
        agg.count_if(c("required") & c("critical") & is_("missing")).alias("critical_missing"))
    share = lambda x: F.when(c("required") == 0, 100).otherwise(rules.rounded(100 * x / c("required"))).cast("int")
    return got.select(
        "notice_id", "required", "optional", c("up").alias("uploaded"), "missing", "approved", "rejected", "pending_review", "critical_missing",
        (c("up") + c("approved")).alias("completed"), share(c("up") + c("approved")).alias("readiness"), share(c("up")).alias("readiness_once"))


@query("a28_tier_counts", with_("candidates") + "SELECT t.tier, count(k.candidate_id) AS n FROM (VALUES ('verified'), ('high'), ('review'), ('low'), ('unknown')) AS t(tier) LEFT JOIN (SELECT candidate_id, CASE WHEN confidence >= 95 THEN 'verified' WHEN confidence >= 85 THEN 'high' WHEN confidence >= 70 THEN 'review' ELSE 'low' END AS tier FROM candidates) k ON k.tier = t.tier GROUP BY 1")
def a28(spark, d):
    from quillon.operators import filters

    counts = n.candidates(spark, d).groupBy(filters.confidence_tier(c("confidence")).alias("tier")).agg(F.count("*").alias("n"))
    return agg.zero_filled(counts, "tier", ("verified", "high", "review", "low", "unknown"), ["n"]).drop("bucket_order")


@query("r27_checklist_generation", "WITH s AS (SELECT unnest(['GST', 'PF', 'ESIC']) AS item, unnest(['per state', 'per state', 'once']) AS kind), g AS (SELECT r_regionkey AS state FROM region) SELECT item || ' ' || state AS name, NULL::VARCHAR AS fiscal_year FROM s, g WHERE kind = 'per state' UNION ALL SELECT item, NULL FROM s WHERE kind = 'once' UNION ALL SELECT 'ITR', y FROM (SELECT unnest(['1996-97', '1995-96', '1994-95']) AS y)")
def r27(spark, d):
    """A catalogue by states and fiscal years: items kept per state once for each, tax returns for the last three complete years."""
    states = table(spark, d, "region").select(c("r_regionkey").cast("string").alias("state"))
    per_state = states.select(F.explode(F.array(F.lit("GST"), F.lit("PF"))).alias("item"), "state").select(F.concat_ws(" ", "item", "state").alias("name"), F.lit(None).cast("string").alias("fiscal_year"))
    one = spark.range(1)
    once = one.select(F.lit("ESIC").alias("name"), F.lit(None).cast("string").alias("fiscal_year"))
    years = one.select(F.lit("ITR").alias("name"), F.explode(dates.last_fiscal_years(F.lit(AS_OF).cast("timestamp"), 3)).alias("fiscal_year"))
    return per_state.unionByName(once).unionByName(years)


@query("r29_document_checks", """SELECT doc_id, errors, warnings, greatest(0, 100 - 25 * errors - 10 * warnings) AS score FROM (SELECT doc_id, (CASE WHEN n_chars > 20000 THEN 1 ELSE 0 END) + (CASE WHEN blank > 2 THEN 1 ELSE 0 END) AS errors,
    (CASE WHEN blank BETWEEN 1 AND 2 THEN 1 ELSE 0 END) + (CASE WHEN NOT regexp_matches(text, '(?i)signed|licen[cs]e|signature') THEN 1 ELSE 0 END) AS warnings FROM (SELECT doc_id, text, n_chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS blank FROM documents))""")
def r29(spark, d):
    blank = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) == ""))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", blank.alias("blank"), c("text").rlike("(?i)signed|licen[cs]e|signature").alias("signed"))
    errors = (c("n_chars") > 20000).cast("int") + (c("blank") > 2).cast("int")
    warnings = c("blank").between(1, 2).cast("int") + (~c("signed")).cast("int")
    return rows.select("doc_id", errors.alias("errors"), warnings.alias("warnings"), F.greatest(F.lit(0), 100 - 25 * errors - 10 * warnings).alias("score"))


@query("r04_section_assignment", with_("candidates") + """SELECT candidate_id, CASE WHEN parameter = 'Contact Officer' THEN CASE WHEN page % 9 = 0 THEN 'annexure_rejected' ELSE 'unrestricted' END WHEN page % 9 = 0 AND parameter <> 'Completion Period' THEN 'annexure_rejected'
    WHEN CASE parameter WHEN 'EMD Amount' THEN page % 2 = 0 WHEN 'Tender Value' THEN page % 2 = 0 WHEN 'Scope of Work' THEN page % 3 = 0 ELSE page % 5 = 0 END THEN 'primary' WHEN page % 3 = 0 THEN 'fallback' ELSE 'section_mismatch' END AS match FROM candidates""")
def r04(spark, d):
    parameter = c("parameter")
    primary = F.when(parameter.isin("EMD Amount", "Tender Value"), "Financial").when(parameter == "Scope of Work", "Scope").when(parameter == "Completion Period", "Compliance")
    sections = F.array_compact(F.array(F.when(c("page") % 2 == 0, "Financial"), F.when(c("page") % 3 == 0, "Scope"), F.when(c("page") % 5 == 0, "Compliance")))
    return n.candidates(spark, d).select("candidate_id", rules.section_match(primary, F.array(primary, F.lit("Scope")), sections, c("page") % 9 == 0).alias("match"))


CONTEXTS = (("EMD", r"(?i)lakh", r"(?i)crore", "in_lakhs_only"), ("EMD", r"(?i)days only", None, "urgent"))


@query("r06_context_rules", with_("notices") + "SELECT notice_id, CASE WHEN regexp_matches(text, '(?i)lakh') AND NOT regexp_matches(text, '(?i)crore') THEN 'in_lakhs_only' WHEN regexp_matches(text, '(?i)days only') THEN 'urgent' END AS reason FROM notices")
def r06(spark, d):
    return n.notices(spark, d).select("notice_id", rules.context_violation(F.lit("EMD"), c("text"), CONTEXTS).alias("reason"))


@query("r10_field_scores", with_("candidates") + "SELECT candidate_id, least(99, floor(least(25, (alias_score / 500.0) / 0.15 * 25) + least(30, confidence / 100.0 * 30) + CASE source WHEN 'AI+RULE' THEN 20 WHEN 'RULE' THEN 8 ELSE 5 END + least(20, page / 15.0 * 20) + CASE WHEN alias_mapped THEN 15 WHEN type_match THEN 12 ELSE 0 END + least(15, confidence / 5.0) + CASE WHEN section_match = 'primary' THEN 5 ELSE 0 END + 0.5))::INT AS score FROM candidates")
def r10(spark, d):
    source = F.when(c("source") == "AI+RULE", "table").when(c("source") == "RULE", "label").otherwise("pattern")
    got = rules.field_score(c("alias_score") / 500, c("confidence") / 100, source, c("page"), c("alias_mapped"), c("type_match"), c("confidence"), c("section_match") == "primary")
    return n.candidates(spark, d).select("candidate_id", got.alias("score"))


@query("r18_dynamic_filter", with_("candidates") + """, s AS (SELECT candidate_id, validation, CASE WHEN length(value) < 2 THEN 0 ELSE CASE WHEN page <= 40 THEN 50 ELSE 0 END + CASE WHEN type_match THEN 20 ELSE 0 END + CASE WHEN validation = 'VALID' THEN 20 ELSE 0 END + CASE WHEN correctness = 'correct' THEN 10 ELSE 0 END END AS score FROM candidates)
    SELECT candidate_id, score, CASE WHEN score < 70 THEN 'REJECT' WHEN validation = 'REVIEW' THEN 'REVIEW' ELSE 'VALID_DYNAMIC' END AS status FROM s""")
def r18(spark, d):
    from quillon.functions.text import irrelevance

    got = rules.dynamic_filter(irrelevance(c("parameter"), c("value")), c("page") <= 40, c("type_match"), F.coalesce(c("validation") == "VALID", F.lit(False)), c("correctness") == "correct", F.coalesce(c("validation") == "REVIEW", F.lit(False)))
    return n.candidates(spark, d).select("candidate_id", got.alias("f")).select("candidate_id", "f.score", "f.status")


@query("r25_experience_match", f"SELECT notice_id, count(*) FILTER (required AND s = 'missing') AS gaps, count(*) FILTER (uploaded OR s = 'approved') AS matching, CASE WHEN count(*) FILTER (required AND s = 'missing') >= 2 THEN 'Not Eligible' WHEN count(*) FILTER (required AND s = 'missing') = 1 THEN 'Partially Eligible' ELSE 'Likely Eligible' END AS status FROM (SELECT *, {STATUS} AS s FROM ({ITEM})) WHERE category IN ('A', 'R') GROUP BY 1")
def r25(spark, d):
    """Experience items are those of two categories."""
    got = items(spark, d).where("category in ('A', 'R')").groupBy("notice_id").agg(agg.count_if(c("required") & (c("status") == "missing")).alias("gaps"), agg.count_if(c("uploaded") | (c("status") == "approved")).alias("matching"))
    return got.withColumn("status", rules.experience_status(c("gaps")))
