"""Strict validation, verification and contexts of the parameters that dossiers state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions import validation as va
from quillon.plans.extraction import NAME, PAIRS_SQL, WITH
from quillon.plans.registry import query
from quillon.plans.texts import held
from quillon.sources import dossiers as ds

c = F.col


def _sql(test, v: str = "v", near: str = "near") -> str:
    """A test of a rule as SQL."""
    if test is None:
        return "true"
    name, *args = test
    if name in ("all", "any"):
        return "(" + (" AND " if name == "all" else " OR ").join(_sql(t, v, near) for t in args) + ")"
    between = lambda x: f"{x} BETWEEN {args[0]} AND {args[1]}"
    return {
        "not": lambda: f"NOT {_sql(args[0], v, near)}", "re": lambda: f"regexp_matches({v}, '{args[0]}')", "context": lambda: f"regexp_matches({near}, '{args[0]}')", "tight": lambda: f"regexp_matches(regexp_replace({v}, '\\s', '', 'g'), '{args[0]}')",
        "chars": lambda: between(f"length({v})"), "words": lambda: between(f"len(string_split_regex({v}, '\\s+'))"), "digits": lambda: f"length(regexp_replace({v}, '[^\\d]', '', 'g')) >= {args[0]}",
        "sentences": lambda: f"len(list_filter(string_split_regex({v}, '[.!?]'), lambda s: length(trim(s)) > 40)) >= {args[0]}", "upper": lambda: f"{v} = upper({v})",
        "first_number": lambda: f"coalesce(TRY_CAST(regexp_extract({v}, '\\d+', 0) AS DECIMAL(38, 0)) BETWEEN {args[0]} AND {args[1]}, false)",
        "date": lambda: f"""(length({v}) BETWEEN 1 AND 120 AND regexp_matches({v}, '{va.DATE}') AND coalesce(TRY_CAST(regexp_extract({v}, '\\b((?:19|20)\\d{{2}})\\b', 1) AS INT) >= 1990, true)
            AND coalesce(TRY_CAST(regexp_extract({v}, '{_DMY}', 1) AS INT) BETWEEN 1 AND 31 AND TRY_CAST(regexp_extract({v}, '{_DMY}', 2) AS INT) BETWEEN 1 AND 12, true))""",
    }[name]()


_DMY = r"\b(\d{1,2})[\s./-](\d{1,2})[\s./-](\d{2,4})\b"
KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{k}'" for k, p in va.KINDS) + " END"
VERDICT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE " + " ".join(f"WHEN {_sql(t)} THEN '{s}|{r}'" for t, s, r in found) + " END" for k, found in va.RULES.items()) + " END"
JUDGED_SQL = WITH + PAIRS_SQL + f""", kinds AS (SELECT p.*, trim(value) AS v, left(text, 300) AS near, {KIND_SQL} AS kind FROM pairs p JOIN dossiers USING (doc_id, page)),
    judged AS (SELECT *, split_part({VERDICT_SQL}, '|', 1) AS status, split_part({VERDICT_SQL}, '|', 2) AS rule FROM kinds WHERE kind IS NOT NULL)"""


def judged(spark, d):
    """Every stated parameter of a kind with rules, judged with the head of its page as context."""
    # patterns cost far more than a shuffle of the pages, so they don't hang on how few row groups the pages are read from
    pages = ds.dossiers(spark, d).repartition("doc_id", "page")
    lines = pages.select("doc_id", "page", F.substring("text", 1, 300).alias("near"), F.posexplode(F.split("text", "\n")).alias("place", "line")).where(c("line").rlike(NAME))
    name = F.trim(F.regexp_replace(F.lower(F.regexp_extract("line", NAME, 1)), r"\s+", " "))
    named = held(lines, name=name, value=F.trim(F.regexp_replace("line", NAME, "")))
    rows = held(named.select("doc_id", "page", (c("place") + 1).alias("place"), "name", "value", "near"), kind=va.kind_of(c("name"))).where("kind is not null")
    return held(rows, verdict=va.strict_verdict(c("kind"), c("value"), c("near"))).select("*", "verdict.*").drop("verdict")


@query("r15_strict_values", JUDGED_SQL + " SELECT doc_id, page, place, name, kind, value, status, rule FROM judged")
def r15(spark, d):
    return judged(spark, d).select("doc_id", "page", "place", "name", "kind", "value", "status", "rule")


_LOW = "page % 7 = 3"
_REVIEWS = ("VERIFIED", "REVIEW", "REJECT")
SECTION_SQL = "CASE place % 5 WHEN 0 THEN 'Financial terms' WHEN 1 THEN 'Scope and services' WHEN 2 THEN 'Annexure B' WHEN 3 THEN '' ELSE 'Eligibility' END"


@query("r19_verification", JUDGED_SQL + f""", e AS (SELECT *, {SECTION_SQL} AS section, {_LOW} AS low, ['VERIFIED', 'REVIEW', 'REJECT'][page % 3 + 1] AS review, place % 100 AS sure, place % 2 = 0 AS mapped, place * 7 % 101 AS score FROM judged),
    s AS (SELECT *, CASE status WHEN 'REJECT' THEN 0 WHEN 'VALID' THEN 30 ELSE 15 END + CASE WHEN low THEN 0 WHEN page <= 5 THEN 20 WHEN page <= 20 THEN 15 WHEN page <= 50 THEN 10 ELSE 5 END
      + CASE WHEN section = '' THEN 5 WHEN regexp_matches(section, '{va.SECTION_NOISE}') THEN 0 WHEN regexp_matches(name, 'emd|tender value|bid') AND section = 'Financial terms' OR contains(name, 'scope') AND section = 'Scope and services' OR contains(name, 'experience') AND section = 'Eligibility' THEN 20 ELSE 10 END
      + CASE WHEN kind IN ('emd', 'bid_date') THEN 10 ELSE 0 END + CASE WHEN place % 6 = 0 OR mapped AND score >= 80 THEN 10 WHEN mapped THEN 5 WHEN length(name) > 12 THEN 8 ELSE 3 END AS total FROM e),
    t AS (SELECT *, total + CASE review WHEN 'VERIFIED' THEN 10 WHEN 'REVIEW' THEN 5 ELSE 0 END AS combined FROM s)
    SELECT doc_id, page, place, total, CASE WHEN status = 'REJECT' OR review = 'REJECT' THEN 'REJECT' WHEN combined >= 70 OR total >= 90 OR review = 'VERIFIED' THEN 'VERIFIED' WHEN review = 'REVIEW' OR combined >= 50 THEN 'REVIEW' ELSE 'REJECT' END AS verified,
      CASE WHEN status = 'REJECT' OR review = 'REJECT' THEN least(sure, 30) WHEN review = 'VERIFIED' AND combined >= 70 THEN greatest(sure, combined) WHEN total >= 90 THEN greatest(92, combined) ELSE greatest(sure, combined) END AS confidence FROM t""")
def r19(spark, d):
    """Scores and status of stated parameters as rows of a master dataset; reviews and alias scores follow from the place of a line."""
    section = F.expr(SECTION_SQL)
    review = F.element_at(F.array(*map(F.lit, _REVIEWS)), (c("page") % 3 + 1).cast("int"))
    rows = judged(spark, d)
    method = F.when(c("place") % 6 == 0, "exact_alias").otherwise("semantic")
    scores = va.verification_scores(c("status"), c("page"), F.expr(_LOW), section, c("name"), c("kind").isin("emd", "bid_date"), method, c("place") % 2 == 0, c("place") * 7 % 101, F.char_length("name") > 12)
    rows = rows.withColumn("total", scores["total"])
    said = va.verification_status(c("total"), review, c("place") % 100, c("status") == "REJECT")
    return rows.select("doc_id", "page", "place", "total", said["status"].alias("verified"), said["confidence"].alias("confidence"))


def _section_sql(text: str) -> str:
    named = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{s}|{n}'" for n, s, p in va.SECTIONS)
    return f"CASE WHEN regexp_matches({text}, '{va.LOW_SECTION}') THEN '20|low_priority_section' {named} ELSE '40|general' END"


@query("r05_section_priority", WITH + f"SELECT doc_id, page, CAST(split_part(s, '|', 1) AS INT) AS score, split_part(s, '|', 2) AS section FROM (SELECT doc_id, page, {_section_sql('lower(text)')} AS s FROM dossiers)")
def r05(spark, d):
    return ds.dossiers(spark, d).select("doc_id", "page", va.section_priority(c("text")).alias("s")).select("doc_id", "page", "s.score", "s.section")


@query("r06_field_contexts", JUDGED_SQL + ", t AS (SELECT *, lower(near || chr(10) || v) AS said FROM judged) SELECT doc_id, page, place, CASE " + " ".join(f"WHEN kind = '{k}' AND regexp_matches(said, '{bad}') AND NOT regexp_matches(said, '{good}') THEN '{reason}'" for k, (bad, good, reason) in va.CONTEXT_RULES.items()) + " END AS reason FROM t")
def r06_contexts(spark, d):
    """Whether a candidate of three kinds stands in a context that is another field's."""
    return judged(spark, d).select("doc_id", "page", "place", va.context_violation(c("kind"), F.concat_ws("\n", "near", "value")).alias("reason"))


_WEIGHTED = " + ".join(f"{n} * {w}::DOUBLE" for n, w in va.FACTORS.items())


@query("r09_weighted_scores", JUDGED_SQL + f""", f AS (SELECT doc_id, page, place, CASE WHEN place % 3 = 0 THEN 100 WHEN place % 3 = 1 THEN 90 ELSE 50 END AS label, CASE WHEN contains(lower(near), 'emd') THEN 85 ELSE 35 END AS context, CAST(split_part({_section_sql('lower(near)')}, '|', 1) AS INT) AS section,
      CASE WHEN page <= 5 THEN 100 WHEN page <= 20 THEN 70 ELSE 40 END AS page_score, CASE WHEN regexp_matches(near || chr(10) || v, '{va.TABLE_WORDS}') THEN 100 WHEN regexp_matches(v, '{va.TABLE_SHAPE}') THEN 85 WHEN regexp_matches(near || chr(10) || v, '(?i)\\bschedule\\b') AND regexp_matches(near || chr(10) || v, '(?i)\\bdate\\b') THEN 75 ELSE 20 END AS "table",
      trim(name || ' ' || v) AS said, place % 101 AS model FROM judged),
    g AS (SELECT *, length(regexp_replace(said, '[^a-zA-Z0-9]', '', 'g')) / length(said)::DOUBLE AS share FROM f),
    h AS (SELECT * REPLACE (page_score AS page_score), CASE WHEN length(said) < 6 THEN 20 WHEN regexp_matches(said, '{va.GARBAGE}') THEN 25 WHEN regexp_matches(said, '[a-zA-Z]{{1,2}}\\s[a-zA-Z]{{1,2}}\\s[a-zA-Z]{{1,2}}') AND length(said) < 40 THEN 40 WHEN share >= 0.5 THEN 95 WHEN share >= 0.35 THEN 75 ELSE 50 END AS scan FROM g)
    SELECT doc_id, page, place, least(100, floor({_WEIGHTED.replace('page *', 'page_score *').replace('table *', '"table" *')} + 0.5))::INT AS score FROM h""")
def r09(spark, d):
    """The older weighted score of candidates: label, context, section, page, table, scan and model."""
    rows = judged(spark, d)
    score = va.weighted_score(
        label=F.when(c("place") % 3 == 0, 100).when(c("place") % 3 == 1, 90).otherwise(50), context=F.when(F.contains(F.lower("near"), F.lit("emd")), 85).otherwise(35), section=va.section_priority(c("near"))["score"],
        page=rules.page_priority(c("page"), F.lit(False)), table=va.table_score(c("near"), c("value")), scan=va.scan_score(c("name"), c("value")), model=c("place") % 101)
    return rows.select("doc_id", "page", "place", score.alias("score"))


#: Labels whose values must not equal a deposit's, and the label of a deposit.
DEPOSIT_NAME, SECURITY_NAME = r"\b(emd|earnest\s+money)\b", r"performance\s+(security|guarantee)"
_WORST = "CASE WHEN 'REJECT' IN ({0}) THEN 'REJECT' WHEN 'REVIEW' IN ({0}) THEN 'REVIEW' ELSE 'VALID' END"


@query("r14_five_layers", JUDGED_SQL + rf""", digits AS (SELECT *, regexp_replace(v, '[^\d]', '', 'g') AS dg, lower(near || chr(10) || v) AS said FROM judged),
    secured AS (SELECT doc_id, arg_min(dg, (page, place)) AS security FROM digits WHERE regexp_matches(name, '{SECURITY_NAME}') GROUP BY 1),
    repeats AS (SELECT doc_id, name, v, count(DISTINCT page) AS pages FROM digits GROUP BY ALL),
    layers AS (SELECT d.*, pages, CASE WHEN length(d.v) < 2 OR regexp_matches(d.name, '^(index|contents|header|footer)$') THEN 'REJECT' WHEN kind IN ('percentage', 'experience') THEN 'REVIEW' ELSE 'VALID' END AS parameter,
        CASE WHEN kind = 'tender_value' AND regexp_matches(said, '{va.CONTEXT_RULES["tender_value"][0]}') AND NOT regexp_matches(said, '{va.CONTEXT_RULES["tender_value"][1]}') OR kind = 'emd' AND regexp_matches(said, '{va.CONTEXT_RULES["emd"][0]}') AND NOT regexp_matches(said, '{va.CONTEXT_RULES["emd"][1]}')
          OR kind = 'bid_date' AND regexp_matches(said, '{va.CONTEXT_RULES["bid_date"][0]}') AND NOT regexp_matches(said, '{va.CONTEXT_RULES["bid_date"][1]}') THEN 'REVIEW' ELSE 'VALID' END AS context,
        CASE WHEN regexp_matches(d.name, '{DEPOSIT_NAME}') AND length(dg) >= 3 AND dg = security THEN 'REJECT' ELSE 'VALID' END AS logic
      FROM digits d LEFT JOIN secured x ON x.doc_id = d.doc_id JOIN repeats r ON r.doc_id = d.doc_id AND r.name = d.name AND r.v = d.v),
    kept AS (SELECT *, least(100, floor(place % 100 + 0.5 * CASE WHEN pages >= 2 THEN least(15, 5 * pages) ELSE 0 END + 0.1 * (page * 3 % 101) + 0.5)) AS sure FROM layers)
    SELECT doc_id, page, place, {_WORST.format('parameter, status, context, logic')} AS status, CASE WHEN {_WORST.format('parameter, status, context, logic')} = 'REJECT' THEN floor(sure * 0.4 + 0.5) ELSE sure END::INT AS confidence FROM kept""")
def r14_five(spark, d):
    """Stated parameters through five layers: label, value by kind, context, logic between parameters, and repeats on other pages."""
    digits, secured = F.regexp_replace("value", r"[^\d]", ""), c("name").rlike(SECURITY_NAME)
    violated = va.context_violation(c("kind"), F.concat_ws("\n", "near", "value")).isNotNull()
    rows = held(judged(spark, d).where("doc_id is not null"), digits=digits, violated=violated).drop("near")
    # windows over one table of judged rows: joins with its own groups would judge every line three times
    rows = rows.withColumns({
        "security": F.min_by("digits", F.when(secured, F.struct("page", "place"))).over(Window.partitionBy("doc_id")), "pages": F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "name", "value")))})
    layers = [
        F.when((F.char_length("value") < 2) | c("name").rlike("^(index|contents|header|footer)$"), "REJECT").when(c("kind").isin("percentage", "experience"), "REVIEW").otherwise("VALID"), c("status"),
        F.when(c("violated"), "REVIEW").otherwise("VALID"),
        F.when(c("name").rlike(DEPOSIT_NAME) & (F.char_length("digits") >= 3) & F.coalesce(c("digits") == c("security"), F.lit(False)), "REJECT").otherwise("VALID"),
    ]
    rows = held(rows, layers=F.array(*layers))
    layers = [c("layers")[k] for k in range(len(layers))]
    return rows.select("doc_id", "page", "place", rules.layered_status(layers, c("page") * 3 % 101, c("place") % 100, c("pages")).alias("r")).select("doc_id", "page", "place", "r.status", "r.confidence")
