"""Lookups of labels and keywords, requirement discovery, merges of variants, and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import aliases as al
from quillon.functions import rules
from quillon.operators import joins, ranking
from quillon.operators.labels import registry_tables, resolved_labels
from quillon.plans.registry import query
from quillon.plans.texts import KEY_SQL, LABELS, LINES, STOP_SQL, held, labels
from quillon.sources import notices as n
from quillon.sources.domain import table
from quillon.sources.notices import with_

c = F.col
#: A registry of standard names: (name, priority, aliases, patterns, semantic words).
REGISTRY = (
    ("Earnest Money", 95, ("EMD", "EMD Amount", "Bid Security"), ("(?i)\\bemd\\b",), ("earnest", "security")),
    ("Tender Number", 95, ("Tender No", "Tender ID"), ("(?i)\\btender\\s*(no|id)\\b",), ()),
    ("Estimated Value", 90, ("Tender Value", "Value of Contract"), ("(?i)\\bestimated\\s+cost\\b",), ()),
    ("Period of Completion", 80, ("Completion Time",), (), ("completion", "period")),
    ("Experience of Works", 75, ("Works Experience",), (), ()),
    ("Last Submission", 70, ("Submission Last Day",), (), ()),
)
#: Forty more entries by rule: each subject with each of its sides, the names of a side standing for one another.
SUBJECTS = ("Bank Guarantee", "Bid Validity", "Contract Award", "Delivery", "Inspection", "Insurance", "Payment", "Warranty")
SIDES = (("Amount", "Sum Payable"), ("Period", "Duration"), ("Terms", "Conditions"), ("Officer", "Contact Person"), ("Place", "Location"))
WHOLE_REGISTRY = REGISTRY + tuple(
    (f"{subject} {side}", 60 - k, (f"{side} of {subject}", f"{subject} {other}"), (rf"(?i)\b{subject.split()[-1].lower()}\s+{side.lower()}s\b",) if k == 1 else (), (*subject.lower().split(), side.lower(), other.split()[0].lower()) if k < 3 else ())
    for subject in SUBJECTS for k, (side, other) in enumerate(SIDES)
)
#: Labels as documents have them, many wordings of the same things, one a line of an order.
_NTH = lambda index, values: f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
_SUBJECT, _SIDE = _NTH("l_partkey % 8", SUBJECTS), _NTH("l_suppkey % 10", [name for pair in SIDES for name in pair])
_WORDING = """CASE l_linenumber % 7 WHEN 0 THEN subject || ' ' || side WHEN 1 THEN side || ' of ' || subject WHEN 2 THEN 'The ' || subject || ' (' || side || ')' WHEN 3 THEN subject || ' ' || side || 's'
    WHEN 4 THEN 'Required ' || subject || ': final ' || side WHEN 5 THEN upper(subject || '-' || side) ELSE side || ' ' || CAST(l_suppkey % 9 AS STRING) || ' ' || subject || ' annex' END"""


def wordings(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_linenumber", "l_suppkey", f"{_SUBJECT} AS subject", f"{_SIDE} AS side").selectExpr(f"{_WORDING} AS label")


def _registry_sql(registry=None, more: str = "") -> str:
    registry = registry or REGISTRY
    seen, exact = set(), []
    for k, (name, *_) in enumerate(registry):
        seen.add(al.plain_key(name))
        exact.append(f"({k}, '{al.plain_key(name)}', 99)")
    for k, (_, _, names, *_) in enumerate(registry):
        for a in names:
            if al.plain_key(a) not in seen:
                seen.add(al.plain_key(a))
                exact.append(f"({k}, '{al.plain_key(a)}', 95)")
    entries = ", ".join(f"({k}, '{e[0]}', {e[1]})" for k, e in enumerate(registry))
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    near = ", ".join(f"({k}, {listed(al.plain_tokens(a))})" for k, e in enumerate(registry) for a in (e[0], *e[2]))
    words = ", ".join(f"({k}, {listed([al.plain_key(w) for w in e[4]])})" for k, e in enumerate(registry) if e[4])
    patterns = ", ".join(f"({k}, '{p}')" for k, e in enumerate(registry) for p in e[3])
    overlap = "CASE WHEN len(t) = 0 OR len(w) = 0 THEN 0 ELSE len(list_intersect(t, w)) / (len(t) + len(w) - len(list_intersect(t, w)))::DOUBLE END"
    return (
        with_("notices") + LABELS + f""", l AS (SELECT DISTINCT label, {KEY_SQL.format('label')} AS key, list_distinct(list_filter(string_split({KEY_SQL.format('label')}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({STOP_SQL}))) AS t FROM (SELECT label FROM labels{more})),
        e AS (SELECT * FROM (VALUES {entries}) AS e(k, name, priority)), x AS (SELECT label, k, s, CASE s WHEN 99 THEN 'exact_canonical' ELSE 'exact_alias' END AS method FROM l JOIN (VALUES {', '.join(exact)}) AS x(k, key, s) USING (key)),
        p AS (SELECT label, k, 90 AS s, 'pattern' AS method FROM l, (VALUES {patterns}) AS p(k, p) WHERE regexp_matches(label, p) OR regexp_matches(key, p)),
        o AS (SELECT label, k, {overlap} AS o, len(list_filter(w, lambda y: contains(key, y))) > 0 AS h FROM l, (VALUES {words}) AS w(k, w)), s AS (SELECT label, k, floor(80.5 + o * 10)::INT AS s, 'semantic' AS method FROM o WHERE o >= 0.45 AND (h OR o >= 0.6)),
        f AS (SELECT label, k, max({overlap}) AS o FROM l, (VALUES {near}) AS w(k, w) GROUP BY 1, 2), g AS (SELECT label, k, CASE WHEN o >= 0.75 THEN 90 WHEN o >= 0.6 THEN 85 ELSE 80 END AS s, 'semantic' AS method FROM f WHERE o >= 0.5),
        u AS (SELECT *, 0 AS way FROM x UNION ALL SELECT *, 1 FROM p UNION ALL SELECT *, 2 FROM s WHERE (label, k) NOT IN (SELECT label, k FROM p) UNION ALL SELECT *, 2 FROM g WHERE (label, k) NOT IN (SELECT label, k FROM p UNION ALL SELECT label, k FROM s))"""
    )


@query("j08_alias_lookup", _registry_sql() + " SELECT label, name AS standard, s AS score FROM x JOIN e USING (k)")
def j08(spark, d):
    found = al.exact(c("label"), REGISTRY)
    return held(labels(spark, d).select("label").distinct(), f=found).where("f is not null").select("label", c("f.name").alias("standard"), "f.score")


@query("j09_alias_match", _registry_sql(WHOLE_REGISTRY, f" UNION ALL SELECT {_WORDING} FROM (SELECT *, {_SUBJECT} AS subject, {_SIDE} AS side FROM lineitem)") + " SELECT label, name AS standard, s AS score, method FROM u JOIN e USING (k) QUALIFY row_number() OVER (PARTITION BY label ORDER BY way > 0, s DESC, priority DESC, k) = 1")
def j09(spark, d):
    """Labels of notices and of lines matched with a registry of 46 entries."""
    every = labels(spark, d).select("label").union(wordings(spark, d))
    return resolved_labels(every, registry_tables(spark, WHOLE_REGISTRY))


NAMES = ("completion periods", "turn over", "contacts", "phone no", "experiences", "certificate")


@query("j10_closest_label", with_("notices") + LABELS + f", x AS (SELECT DISTINCT label, v.k, v.name, 1 - levenshtein(lower(label), v.name) / greatest(length(label), length(v.name)) AS s FROM labels, (VALUES {', '.join(f'({k}, {chr(39)}{w}{chr(39)})' for k, w in enumerate(NAMES))}) AS v(k, name)) SELECT label, name AS known FROM x WHERE s >= 0.84 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, k) = 1")
def j10_label(spark, d):
    return held(labels(spark, d).select("label").distinct(), known=al.closest(c("label"), list(NAMES))).where("known is not null")


CATALOGUE = [("guards", ["Security guard", "watch and ward"]), ("vehicles", ["fleet", "vehicle hire"]), ("iso", ["ISO 9001"]), ("absent", ["submarine"])]


@query("j12_first_mention", with_("notices") + ", m AS (SELECT notice_id // 30 AS doc, page_number, item, k, term FROM notices, (VALUES ('guards', 0, 'security guard'), ('guards', 1, 'watch and ward'), ('vehicles', 0, 'fleet'), ('vehicles', 1, 'vehicle hire'), ('iso', 0, 'iso 9001'), ('absent', 0, 'submarine')) AS v(item, k, term) WHERE contains(lower(text), term)) SELECT doc, item, page_number AS page, term FROM m QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY page_number, k) = 1")
def j12(spark, d):
    pages = n.notices(spark, d).withColumn("doc", F.floor(c("notice_id") / 30))
    return joins.first_mention(pages, CATALOGUE, "text", "doc", "page_number")


@query("j13_checklist_uploads", with_("candidates") + """, up AS (SELECT notice_id, candidate_id, lower(parameter) AS f FROM candidates), items AS (SELECT item, term FROM (VALUES ('deposit', 'emd'), ('deposit', 'earnest'), ('contact', 'officer'), ('scope', 'scope')) AS v(item, term)), hit AS (SELECT notice_id, item, max(candidate_id) AS candidate_id FROM up, items WHERE contains(f, term) GROUP BY 1, 2),
    linked AS (SELECT notice_id, 'deposit' AS item, min(candidate_id) AS candidate_id FROM up WHERE notice_id % 10 = 0 GROUP BY 1) SELECT coalesce(h.notice_id, l.notice_id) AS notice_id, coalesce(h.item, l.item) AS item, coalesce(l.candidate_id, h.candidate_id) AS upload FROM hit h FULL JOIN linked l ON l.notice_id = h.notice_id AND l.item = h.item""")
def j13(spark, d):
    """Checklist items with their upload: the linked one first, else the newest whose file name holds a keyword."""
    uploads = n.candidates(spark, d).select("notice_id", "candidate_id", "parameter", (-c("candidate_id")).alias("age"))
    found = joins.first_with_terms(uploads, "notice_id", "age", c("parameter"), [("deposit", ["emd", "earnest"]), ("contact", ["officer"]), ("scope", ["scope"])], ["candidate_id"])
    linked = uploads.where("notice_id % 10 = 0").groupBy("notice_id").agg(F.min("candidate_id").alias("linked")).withColumn("item", F.lit("deposit"))
    return found.join(linked, ["notice_id", "item"], "full").select("notice_id", "item", F.coalesce("linked", "candidate_id").alias("upload"))


@query("j14_j18_parameter_by_term", with_("candidates") + "SELECT notice_id, item, arg_min(candidate_id, (page, candidate_id)) AS candidate_id FROM candidates, (VALUES ('period', 'completion'), ('value', 'tender value'), ('value', 'value'), ('person', 'officer')) AS v(item, term) WHERE contains(lower(parameter || ' ' || value), term) GROUP BY 1, 2")
def j14(spark, d):
    """The first parameter, by page, whose name or value holds one of an item's terms of over two characters."""
    rows = n.candidates(spark, d).withColumn("order", F.struct("page", "candidate_id"))
    return joins.first_with_terms(rows, "notice_id", "order", F.concat_ws(" ", "parameter", "value"), [("period", ["completion", "om"]), ("value", ["tender value", "value"]), ("person", ["officer"])], ["candidate_id"], shortest=2)


@query("r28_requirements", with_("notices") + """, m AS (SELECT notice_id // 30 AS doc, min(page_number) FILTER (regexp_matches(lower(text), 'security guard|watch and ward')) AS guards, min(page_number) FILTER (contains(lower(text), 'iso 9001')) AS iso FROM notices GROUP BY 1)
    SELECT doc, item, page IS NOT NULL AS mentioned, item = 'iso' OR page IS NOT NULL AS required, CASE WHEN page IS NOT NULL THEN 'text' WHEN item = 'iso' THEN 'baseline' ELSE 'none' END AS source, page FROM (SELECT doc, 'guards' AS item, guards AS page FROM m UNION ALL SELECT doc, 'iso', iso FROM m)""")
def r28(spark, d):
    """Items of a catalogue per document: required always, or only where the text mentions them."""
    pages = n.notices(spark, d).withColumn("doc", F.floor(c("notice_id") / 30))
    found = joins.first_mention(pages, [x for x in CATALOGUE if x[0] in ("guards", "iso")], "text", "doc", "page_number")
    every = pages.select("doc").distinct().select("doc", F.explode(F.array(F.lit("guards"), F.lit("iso"))).alias("item"))
    rows = every.join(found, ["doc", "item"], "left").withColumns({"mentioned": c("page").isNotNull(), "always": c("item") == "iso"})
    return rows.select("doc", "item", "mentioned", (c("always") | c("mentioned")).alias("required"), F.when(c("mentioned"), "text").when(c("always"), "baseline").otherwise("none").alias("source"), "page")


SECTIONS = (("Notice", r"(?i)notice|invitation", ("tender", "bid")), ("Financial", r"(?i)emd amount", ("lakh", "crore")), ("Annexure", r"(?i)annexure", ("form",)))


def page_sections(spark, d):
    """(notice_id, page_number, s) of each page's sections, s a struct<section, score, confidence, words>; hits and scores are worked out once a page."""
    early = F.when(c("page_number") <= 5, 6).when(c("page_number") <= 20, 3).otherwise(0)
    rows = n.notices(spark, d).select("notice_id", "page_number", F.substring("text", 1, 5000).alias("head")).withColumn("low", F.lower("head"))
    patterns = [F.when(c("head").rlike(p), 8).otherwise(0).alias(f"p{k}") for k, (_, p, _) in enumerate(SECTIONS)]
    rows = rows.select("notice_id", "page_number", *patterns, *[rules.hits(c("low"), w).alias(f"h_{w}") for *_, ws in SECTIONS for w in ws])
    scores = [c(f"p{k}") + sum((c(f"h_{w}") * 2 for w in ws), F.lit(0)) for k, (*_, ws) in enumerate(SECTIONS)]
    rows = rows.select("*", *[F.when(s > 0, s + (0 if name == "Annexure" else early)).otherwise(0).cast("int").alias(f"s{k}") for k, (s, (name, *_)) in enumerate(zip(scores, SECTIONS))])
    made = []
    for k, (name, _, words) in enumerate(SECTIONS):
        base = F.least(F.lit(99), F.greatest(F.lit(35), rules.rounded(40 + 2.5 * c(f"s{k}"))))
        made.append(F.when(c(f"s{k}") >= 4, F.struct(F.lit(name).alias("section"), c(f"s{k}").alias("score"), base.cast("int").alias("confidence"), F.array_compact(F.array(*[F.when(c(f"h_{w}") > 0, w) for w in words])).alias("words"))))
    return rows.select("notice_id", "page_number", F.explode_outer(F.array(*made)).alias("s")).where("s is not null")


SECTION_SQL = with_("notices") + """, s AS (SELECT notice_id, notice_id // 30 AS doc, page_number, lower(text) AS t, CASE WHEN page_number <= 5 THEN 6 WHEN page_number <= 20 THEN 3 ELSE 0 END AS early FROM notices),
    h AS (SELECT *, len(regexp_extract_all(t, '\\btender\\b')) AS a1, len(regexp_extract_all(t, '\\bbid\\b')) AS a2, len(regexp_extract_all(t, '\\blakh\\b')) AS b1, len(regexp_extract_all(t, '\\bcrore\\b')) AS b2, CASE WHEN regexp_matches(t, 'notice|invitation') THEN 8 ELSE 0 END AS p FROM s),
    r AS (SELECT notice_id, doc, page_number, 'Notice' AS section, p + 2 * (a1 + a2) + CASE WHEN p + a1 + a2 > 0 THEN early ELSE 0 END AS score, CASE WHEN a1 > 0 THEN 1 ELSE 0 END AS w1, CASE WHEN a2 > 0 THEN 1 ELSE 0 END AS w2 FROM h UNION ALL
    SELECT notice_id, doc, page_number, 'Financial', 8 + 2 * (b1 + b2) + early, CASE WHEN b1 > 0 THEN 1 ELSE 0 END, CASE WHEN b2 > 0 THEN 1 ELSE 0 END FROM h), q AS (SELECT *, least(99, greatest(35, floor(40 + 2.5 * score + 0.5)))::INT AS confidence FROM r WHERE score >= 4) """


@query("r03_page_sections", SECTION_SQL + "SELECT notice_id, section, score, confidence FROM q")
def r03(spark, d):
    return page_sections(spark, d).select("notice_id", "s.section", "s.score", "s.confidence")


@query("a16_section_rollup", SECTION_SQL + "SELECT doc, section, least(99, floor(avg(confidence) + 0.5))::INT AS confidence, min(page_number) AS first, max(page_number) AS last, count(DISTINCT page_number) AS pages, max(w1) + max(w2) AS words FROM q GROUP BY 1, 2")
def a16(spark, d):
    got = page_sections(spark, d).select(F.floor(c("notice_id") / 30).alias("doc"), "page_number", "s")
    words = F.array_distinct(F.flatten(F.collect_set("s.words")))
    return got.groupBy("doc", "s.section").agg(
        F.least(F.lit(99), rules.rounded(F.avg("s.confidence"))).cast("int").alias("confidence"), F.min("page_number").alias("first"), F.max("page_number").alias("last"),
        F.countDistinct("page_number").alias("pages"), F.size(F.slice(words, 1, 12)).cast("long").alias("words"))


@query("w08_rule_match", with_("notices") + LINES + """, m AS (SELECT notice_id, field, seq, confidence FROM lines, (VALUES ('amount', 1, '(?i)^emd.*rs', 80), ('amount', 2, '(?i)lakh|crore', 80), ('amount', 3, '(?i)^estimated cost', 90), ('person', 4, '(?i)^contact', 70)) AS v(field, seq, p, confidence) WHERE regexp_matches(line, p))
    SELECT notice_id, field, seq, confidence FROM m QUALIFY row_number() OVER (PARTITION BY notice_id, field ORDER BY confidence DESC, seq) = 1""")
def w08(spark, d):
    """The best rule of a table for each field; the earlier rule wins ties, as only a better score replaces it."""
    rule = (("amount", 1, r"(?i)^emd.*rs", 80), ("amount", 2, "(?i)lakh|crore", 80), ("amount", 3, "(?i)^estimated cost", 90), ("person", 4, "(?i)^contact", 70))
    lines_of = F.split("text", "\n")
    hit = lambda p: F.exists(lines_of, lambda x: x.rlike(p))
    made = [F.when(hit(p), F.struct(F.lit(f).alias("field"), F.lit(s).alias("seq"), F.lit(q).alias("confidence"))) for f, s, p, q in rule]
    rows = n.notices(spark, d).select("notice_id", F.explode(F.array_compact(F.array(*made))).alias("m")).select("notice_id", "m.*")
    best = F.min_by(F.struct("seq", "confidence"), F.struct(-c("confidence"), "seq"))
    return rows.groupBy("notice_id", "field").agg(best.alias("b")).select("notice_id", "field", "b.seq", "b.confidence")


@query("w09_alias_variants", with_("candidates") + f"""SELECT notice_id, k, count(*) AS variants, arg_min(candidate_id, (-priority, page, -confidence, candidate_id)) AS winner, count(*) - 1 AS removed FROM (SELECT *, CASE WHEN parameter IN ('EMD Amount', 'Tender Value') THEN 'money' ELSE {KEY_SQL.format('parameter')} END AS k,
    CASE WHEN page <= 5 THEN 100 WHEN page <= 20 THEN 70 ELSE 40 END AS priority FROM candidates) GROUP BY 1, 2""")
def w09(spark, d):
    """Variants of one standard parameter merged to the best by page priority, page and confidence."""
    from quillon.functions.text import alias_key

    key = F.when(c("parameter").isin("EMD Amount", "Tender Value"), "money").otherwise(alias_key(c("parameter")))
    rows = n.candidates(spark, d).withColumns({"k": key, "priority": rules.page_priority(c("page"), F.lit(False))})
    best = F.min_by("candidate_id", F.struct(-c("priority"), "page", -c("confidence"), "candidate_id"))
    return rows.groupBy("notice_id", "k").agg(F.count("*").alias("variants"), best.alias("winner")).withColumn("removed", c("variants") - 1)


LISTED = "CASE o_orderkey % 4 WHEN 0 THEN 'the supply and installation of equipment ' || o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN '  The Supply and  installation of equipment ' || o_orderpriority ELSE 'the supply and installation of equipment ' || o_orderpriority || ' with spares' END"


@query("w11_list_merge", f"""WITH v AS (SELECT DISTINCT o_custkey AS notice, lower(trim(regexp_replace({LISTED}, '\\s+', ' ', 'g'))) AS x FROM orders),
    k AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v AS o WHERE o.notice = v.notice AND o.x <> v.x AND contains(o.x, v.x) AND length(v.x) > 30 AND length(o.x) > 30))
    SELECT notice, count(*) AS n_values, max(length(x)) AS longest, md5(string_agg(x, '|' ORDER BY x)) AS said FROM k GROUP BY 1""")
def w11(spark, d):
    """Values of a list field kept once; of two long ones of which one holds the other, the longer stays."""
    rows = table(spark, d, "orders").select(c("o_custkey").alias("notice"), F.expr(LISTED).alias("value"), (c("o_orderkey") % 100).alias("confidence"))
    merged = ranking.merged_values(rows, "notice", "value", "confidence")
    return merged.groupBy("notice").agg(F.count("*").alias("n_values"), F.max(F.char_length("value")).alias("longest"), F.md5(F.array_join(F.array_sort(F.collect_list(F.lower("value"))), "|")).alias("said"))
