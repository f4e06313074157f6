"""Text, date and money expressions applied to notices, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import dates, money
from quillon.functions import text as tx
from quillon.operators import aggregates as agg
from quillon.operators import documents as docs
from quillon.operators import filters
from quillon.plans.registry import query
from quillon.plans.scoring import AMOUNT_SQL
from quillon.sources import notices as n
from quillon.sources.domain import table
from quillon.sources.notices import with_

c = F.col
LINES = ", lines AS (SELECT notice_id, page_number, pos, trim(line) AS line FROM (SELECT notice_id, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM notices))"
LABELS = LINES + ", labels AS (SELECT notice_id, pos, trim(split_part(line, ':', 1)) AS label, trim(substr(line, strpos(line, ':') + 1)) AS value FROM lines WHERE contains(line, ': ') OR line LIKE '%:')"
NOISE_SQL = "(length(@) <= 2 OR regexp_matches(@, '" + tx.NOISE + "') OR regexp_matches(@, '" + tx.LEADER + "') OR regexp_matches(@, '" + tx.NUMBERED + "'))"
DOC_LINES = "dl AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), good AS (SELECT * FROM dl WHERE line <> '')"
KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[:\\-–—.]+', ' ', 'g'), '[()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))"
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def lines(spark, d):
    at = n.notices(spark, d)
    # the outer form, as the inner one has each text made again to see whether it has lines
    rows = at.select("notice_id", "page_number", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where("pos is not null")
    return rows.select("notice_id", "page_number", (c("pos") + 1).alias("pos"), F.trim("line").alias("line"))


def labels(spark, d):
    rows = lines(spark, d).where(F.contains("line", F.lit(": ")) | c("line").endswith(":"))
    return rows.select("notice_id", "pos", F.trim(F.substring_index("line", ":", 1)).alias("label"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))


def held(rows, **values):
    """Rows with columns that are worked out once: filters behind them are not pushed before them, where they would work them out again."""
    made = F.explode_outer(F.array(F.struct(*[x.alias(k) for k, x in values.items()]))).alias("held")
    return rows.select("*", made).select(*rows.columns, *[c(f"held.{k}").alias(k) for k in values])


@query("st01_squeezed", with_("notices") + "SELECT notice_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM notices")
def st01(spark, d):
    return n.notices(spark, d).select("notice_id", F.md5(tx.squeezed(c("text"))).alias("digest"))


@query("st02_alias_keys", with_("notices") + LABELS + f"SELECT {KEY_SQL.format('label')} AS k, count(*) AS n FROM labels GROUP BY 1")
def st02(spark, d):
    return labels(spark, d).groupBy(tx.alias_key(c("label")).alias("k")).agg(F.count("*").alias("n"))


@query("st03_token_overlap", with_("notices") + LABELS + f""", t AS (SELECT DISTINCT label, list_distinct(list_filter(string_split({KEY_SQL.format('label')}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({STOP_SQL}))) AS a, ['emd', 'period', 'completion'] AS b FROM labels)
    SELECT label, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + 3.0 - len(list_intersect(a, b))) END, 4) AS overlap FROM t""")
def st03(spark, d):
    other = tx.tokens(F.lit("EMD period of completion"))
    return labels(spark, d).select("label").distinct().select("label", F.round(tx.jaccard(tx.tokens(c("label")), other), 4).alias("overlap"))


@query("st04_edit_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)), 4) AS similarity FROM part")
def st04(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(tx.edit_similarity(c("p_name"), F.lower("p_type")), 4).alias("similarity"))


@query("st05_st06_keyword_score", with_("notices") + "SELECT notice_id, 2 * len(regexp_extract_all(lower(text), '\\band\\b')) + 3 * ((length(text) - length(replace(lower(text), 'tender no', ''))) // 9) + 5 * ((length(text) - length(replace(lower(text), 'watch and ward', ''))) // 14) AS score FROM notices")
def st05(spark, d):
    words = ("and", "tender no", "watch and ward")
    return n.notices(spark, d).select("notice_id", sum((tx.keyword_hits(c("text"), w) * tx.keyword_weight(w) for w in words), F.lit(0)).cast("long").alias("score"))


ST07_LABEL = r"^[ \t]*([A-Z][A-Za-z0-9 ()./&-]{1,60}?)[ \t]*:[ \t]*"


@query("st07_label_values", with_("notices") + rf""", l AS (SELECT notice_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM notices),
    m AS (SELECT *, regexp_matches(line, '{ST07_LABEL}') AS opens FROM l), g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY notice_id ORDER BY pos) AS k FROM m),
    r AS (SELECT notice_id, k, trim(arg_min(regexp_extract(line, '{ST07_LABEL}', 1), pos)) AS label, trim(regexp_replace(string_agg(CASE WHEN opens THEN regexp_replace(line, '{ST07_LABEL}', '') ELSE line END, chr(10) ORDER BY pos), '\s+', ' ', 'g')) AS value FROM g WHERE k > 0 GROUP BY 1, 2)
    SELECT notice_id, label, value FROM r WHERE value <> ''""")
def st07(spark, d):
    """Labels with values that run on over the lines that follow, up to the next label."""
    return n.notices(spark, d).select("notice_id", F.explode(tx.label_values(c("text"))).alias("r")).select("notice_id", "r.label", "r.value")


@query("st08_parameters", with_("notices") + LINES + """, p AS (SELECT *, CASE WHEN page_number <= 5 THEN 8 WHEN page_number <= 15 THEN 4 ELSE 0 END AS boost FROM lines)
    SELECT notice_id, pos, 'colon' AS family, trim(regexp_extract(line, '^\\s*([A-Za-z][^:|\\t\\n]{1,60}?)\\s*:\\s*(\\S[^\\n]*)$', 1)) AS name, 88 + boost AS confidence FROM p WHERE regexp_matches(line, '^\\s*[A-Za-z][^:|\\t\\n]{1,60}?\\s*:\\s*\\S')""")
def st08(spark, d):
    got = held(lines(spark, d), p=tx.parameters(c("line"), c("page_number"))).where("p is not null")
    return got.select("notice_id", "pos", "p.family", "p.name", "p.confidence")


@query("st09_cut_at_label", with_("notices") + "SELECT notice_id, trim(regexp_replace(replace(text, chr(10), ' '), '(?s)\\s+[A-Z][A-Za-z ]{2,40}\\s*:.*$', '')) AS value FROM notices")
def st09(spark, d):
    return n.notices(spark, d).select("notice_id", tx.cut_at_label(F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))


RAW_NUMBER = "CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey % 9 + 1 AS STRING) || '.5E+7' WHEN 1 THEN CAST(l_partkey % 7 AS STRING) || lpad(CAST(l_suppkey AS STRING), 14 + CAST(l_partkey % 3 AS INT), '0') ELSE CAST(l_extendedprice AS STRING) END"


@query("st10_broken_numbers", f"SELECT l_orderkey, l_linenumber, raw, regexp_matches(raw, '^\\d+(\\.\\d+)?[eE][+-]?\\d+$') OR coalesce(TRY_CAST(regexp_extract(raw, '^(\\d{{1,30}})$', 1) AS DOUBLE) > 1e14, false) AS broken FROM (SELECT *, {RAW_NUMBER} AS raw FROM lineitem)")
def st10(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{RAW_NUMBER} AS raw")
    return rows.select("l_orderkey", "l_linenumber", "raw", tx.broken_number(c("raw")).alias("broken"))


@query("st11_noise_lines", f"WITH {DOC_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({NOISE_SQL.replace('@', 'line')}) AS n_noise FROM good GROUP BY 1")
def st11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(tx.lines(c("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), agg.count_if(tx.is_noise(c("line"))).alias("n_noise"))


@query("st12_contents_pages", with_("notices") + LINES + f", g AS (SELECT notice_id, CASE WHEN notice_id % 4 = 0 THEN (pos - 1) || ' Title of the part ' || pos ELSE line END AS line FROM lines WHERE line <> '') SELECT notice_id, count(*) >= 4 AND count(*) FILTER ({NOISE_SQL.replace('@', 'line')}) >= 0.45 * count(*) AS is_contents FROM g GROUP BY 1")
def st12(spark, d):
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(" Title of the part "), (i + 1).cast("string"))), "\n")
    return n.notices(spark, d).select("notice_id", tx.is_contents_page(F.when(c("notice_id") % 4 == 0, numbered).otherwise(c("text"))).alias("is_contents"))


@query("st13_without_noise", f"WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT {NOISE_SQL.replace('@', 'x')}), chr(10))) AS digest FROM d")
def st13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.without_noise(c("text"))).alias("digest"))


@query("st14_w17_joined_lines", """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM l WHERE line <> ''),
    b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k), g AS (SELECT *, sum(CASE WHEN NOT regexp_matches(before, '[.:;!?]$') AND regexp_matches(line, '^[a-zà-ÿ]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM b),
    j AS (SELECT doc_id, block, string_agg(line, ' ' ORDER BY pos) AS said FROM g GROUP BY 1, 2), t AS (SELECT doc_id, string_agg(said, chr(10) ORDER BY block) AS said, count(*) AS n FROM j GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0) AS n, md5(coalesce(said, '')) AS digest FROM documents d LEFT JOIN t USING (doc_id) WHERE text IS NOT NULL""")
def st14(spark, d):
    """Lines of whole documents that run on into the next one, joined; the number of lines left and their digest."""
    joined = table(spark, d, "documents").where("text is not null").select("doc_id", tx.joined_lines(c("text")).alias("t"))
    return joined.select("doc_id", F.when(c("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("n"), F.md5("t").alias("digest"))


@query("st15_snippets", with_("notices") + LINES + "SELECT notice_id, substr(arg_min(line, pos), 1, 30) AS evidence FROM lines WHERE contains(line, 'Lakh') GROUP BY 1")
def st15(spark, d):
    return n.notices(spark, d).select("notice_id", tx.snippet(c("text"), "Lakh", 30).alias("evidence")).where("evidence is not null")


@query("st16_columns", with_("notices") + LINES + "SELECT notice_id, pos, CASE WHEN regexp_matches(line, '^[^:]+:\\s*\\S') THEN 2 ELSE 1 END AS n, CASE WHEN regexp_matches(line, '^[^:]+:\\s*\\S') THEN trim(split_part(line, ':', 1)) ELSE line END AS first FROM lines")
def st16(spark, d):
    cells = lines(spark, d).select("notice_id", "pos", tx.split_columns(c("line")).alias("cells"))
    return cells.select("notice_id", "pos", F.size("cells").cast("long").alias("n"), c("cells")[0].alias("first"))


TWICE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || upper(p_name) WHEN 1 THEN p_name || ' other words' WHEN 2 THEN p_type || ' ' || p_type ELSE p_type || ' a ' || p_type || '  A' END"


@query("st17_repeated_text", rf"WITH s AS (SELECT p_partkey, string_split_regex(trim(lower({TWICE})), '\s+') AS ws FROM part) SELECT p_partkey, len(ws) >= 4 AND len(ws) % 2 = 0 AND ws[:len(ws) // 2] = ws[len(ws) // 2 + 1:] AS repeated FROM s")
def st17(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.twice_the_same(F.expr(TWICE)).alias("repeated"))


@query("st18_headings", with_("notices") + LINES + "SELECT notice_id, count(*) AS n FROM lines WHERE regexp_matches(line, '^[A-Z][A-Z0-9\\s\\-–—:()]{6,}$') GROUP BY 1")
def st18(spark, d):
    return n.notices(spark, d).select("notice_id", F.size(tx.headings(c("text"))).cast("long").alias("n"))


#: What the cascade of reasons needs of a value besides itself.
TIGHT_SQL = r"string_split_regex(lower({0}), '\s+') AS ws, len(string_split_regex({0}, '\s+')) AS words, regexp_replace({0}, '\s+', '', 'g') AS tight"


def _either(p: str) -> str:
    return f"(regexp_matches(l, '{p}') OR regexp_matches(v, '{p}'))"


REASON_SQL = rf"""CASE WHEN l = '' THEN 'empty_label' WHEN length(v) < 2 THEN 'empty_value' WHEN regexp_matches(l, '{tx.HEADING_ONLY}') THEN 'heading_only' WHEN regexp_matches(l, '{tx.CLAUSE_LABEL}') OR regexp_matches(l, '{tx.CLAUSE_ONLY}') THEN 'clause_number'
    WHEN regexp_matches(l, '{tx.ANNEX_LABEL}') OR regexp_matches(l, '{tx.ANNEX_REFERENCE}') AND length(v) < 40 AND NOT regexp_matches(v, '\d') OR regexp_matches(v, '{tx.ANNEX_REFERENCE}') AND words <= 6 THEN 'annexure_reference'
    WHEN {_either(tx.CONTENTS_ENTRY)} OR lower(l) IN ('index', 'contents') THEN 'table_of_contents' WHEN regexp_matches(l, '{tx.CONTACT_LABEL}') OR regexp_matches(l, '{tx.CONTACT_HEAD}') OR regexp_matches(l, '{tx.MAIL_LABEL}') THEN 'contact_block' WHEN regexp_matches(v, '{tx.MAIL}') THEN 'email_block'
    WHEN regexp_matches(v, '{tx.PHONE}') AND length(regexp_replace(v, '\D', '', 'g')) >= 7 THEN 'phone_number' WHEN {_either(tx.PAGE_LABEL)} THEN 'page_number' WHEN regexp_matches(l, '{tx.HEADER_LABEL}') THEN 'header_footer' WHEN {_either(tx.METADATA)} THEN 'document_metadata'
    WHEN regexp_matches(l, '{tx.SECTION_REFERENCE}') THEN 'section_reference' WHEN regexp_matches(l, '{tx.CLAUSE_REFERENCE}') THEN 'clause_reference' WHEN regexp_matches(l, '{tx.TITLE_LABEL}') THEN 'repeated_title' WHEN regexp_matches(l, '{tx.CONTACT}') AND NOT regexp_matches(l, '{tx.BUSINESS_WORD}') THEN 'contact_block'
    WHEN regexp_matches(l, '{tx.NAVIGATION_LABEL}') OR regexp_matches(l || ' ' || v, '{tx.NAVIGATION}') AND words <= 12 THEN 'navigation_content'
    WHEN length(v) >= 6 AND len(list_filter(range(1, length(tight) // 2 + 1), lambda k: length(tight) % k = 0 AND repeat(left(tight, k), (length(tight) // k)::BIGINT) = tight)) > 0 OR words >= 4 AND words % 2 = 0 AND ws[:words // 2] = ws[words // 2 + 1:] THEN 'repeated_text' WHEN lower(l) = lower(v) THEN 'label_equals_value' ELSE 'relevant' END"""


@query("st19_irrelevance", with_("notices") + LABELS + f", p AS (SELECT label AS l, value AS v, {TIGHT_SQL.format('value')} FROM labels) SELECT {REASON_SQL} AS reason, count(*) AS n FROM p GROUP BY 1")
def st19(spark, d):
    return held(labels(spark, d), reason=F.coalesce(tx.irrelevance(c("label"), c("value")), F.lit("relevant"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("st20_paragraphs", "SELECT conv_id, turn, trim(text) = '' OR length(trim(text)) > 200 OR len(list_filter(string_split_regex(trim(text), '[.!?]'), lambda x: length(trim(x)) > 40)) >= 2 AS is_paragraph FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def st20(spark, d):
    """Whether each turn is a paragraph; a null one is as empty as an empty one."""
    return table(spark, d, "conversations").select("conv_id", "turn", tx.is_paragraph(F.coalesce("text", F.lit(""))).alias("is_paragraph"))


@query("st21_rolling_hash", """WITH u AS (SELECT page_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(url, ''), lambda x: ord(x)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM pages WHERE url <> '')
    SELECT page_id, substr(lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)), 1, 6) AS hash FROM u""")
def st21(spark, d):
    """Short hashes of addresses, which are ASCII here; code units beyond the basic plane are tested beside it."""
    return table(spark, d, "pages").where("url <> ''").select("page_id", tx.rolling_hash36(c("url")).alias("hash"))


@query("st22_filters_hash", with_("fields") + "SELECT notice_id, substr(sha256(contact), 1, 16) AS hash FROM fields")
def st22(spark, d):
    return n.fields(spark, d).select("notice_id", tx.filters_hash(c("contact")).alias("hash"))


def _group_sql(name, both):
    whens = " ".join(f"WHEN regexp_matches({name}, '(?i){p}') OR regexp_matches({both}, '(?i){p}') THEN '{g}'" for g, ps in tx.GROUPS for p in ["|".join(ps)])
    return f"CASE {whens} ELSE '{tx.REST}' END"


@query("st23_parameter_groups", with_("notices") + LABELS + f"SELECT label, {_group_sql('label', 'label || chr(32) || value')} AS grp, count(*) AS n FROM labels GROUP BY 1, 2")
def st23(spark, d):
    return held(labels(spark, d), grp=tx.parameter_group(c("label"), c("value"))).groupBy("label", "grp").agg(F.count("*").alias("n"))


@query("st26_amount_scores", with_("notices") + LABELS + """, a AS (SELECT l.notice_id, n.page_number, l.label, CAST(nullif(regexp_replace(regexp_extract(l.value, '\\d[\\d,]*', 0), ',', '', 'g'), '') AS DOUBLE) AS v FROM labels l JOIN notices n USING (notice_id) WHERE l.label IN ('EMD Amount', 'Estimated Cost', 'Turnover'))
    SELECT notice_id, label, 80 + CASE WHEN page_number < 10 THEN 20 ELSE 0 END + CASE WHEN v > 100000 THEN 20 ELSE 0 END AS score FROM a WHERE v IS NOT NULL""")
def st26(spark, d):
    """Amounts beside their keyword: 50 for the page, 30 within 200 characters, 20 for an early page, 20 above a hundred thousand."""
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.regexp_extract("text", rf"{k}: [^\d\n]*(\d[\d,]*)", 1).alias("digits"), F.instr("text", k).alias("at")) for k in ("EMD Amount", "Estimated Cost", "Turnover")]))
    rows = n.notices(spark, d).select("notice_id", "page_number", "text", found.alias("f")).where("f.digits <> ''")
    distance = F.expr("locate(f.digits, text, f.at)") - c("f.at")
    value = F.regexp_replace("f.digits", ",", "").cast("double")
    score = 50 + F.when(distance <= 200, 30).otherwise(0) + F.when(c("page_number") < 10, 20).otherwise(0) + F.when(value > 100000, 20).otherwise(0)
    return rows.select("notice_id", "f.label", score.alias("score"))


TAGS = (("eligibility", 0.5, ("(?i)experience", "(?i)turnover")), ("financial", 0.45, ("(?i)emd", "(?i)lakh")), ("annexure", 0.9, ("(?i)annexure",)))


@query("st30_document_map", with_("notices") + """, t AS (SELECT notice_id // 30 AS doc, page_number, CASE WHEN regexp_matches(text, '(?i)lakh') THEN 'eligibility+financial' ELSE 'eligibility' END AS tags FROM notices), i AS (SELECT *, page_number - row_number() OVER (PARTITION BY doc, tags ORDER BY page_number) AS g FROM t)
    SELECT doc, tags, min(page_number) AS first, max(page_number) AS last FROM i GROUP BY doc, tags, g""")
def st30(spark, d):
    """Pages tagged by summed pattern weights of .85 or more, neighbours of the same tags as one range."""
    head = F.substring("text", 1, 3500)
    tagged = [F.when(sum((F.when(head.rlike(p), w).otherwise(0.0) for p in ps), F.lit(0.0)) >= 0.85, t) for t, w, ps in TAGS]
    pages = n.notices(spark, d).select(F.floor(c("notice_id") / 30).alias("doc"), "page_number", F.concat_ws("+", *tagged).alias("tags"))
    return docs.ranges(pages.withColumn("tags", F.when(c("tags") == "", "general").otherwise(c("tags"))), "doc", "page_number", "tags")


RECOVER_PATTERN, RECOVER_LABEL = r"Last Date:\s*(\d{4}-\d{2}-\d{2})", r"(?i)Last Date[^:\n]{0,50}[:\s]+([^\n]{3,200})"


@query("st31_recovery", with_("notices") + f", r AS (SELECT notice_id, regexp_extract(text, '{RECOVER_PATTERN}', 1) AS a, trim(regexp_extract(text, '{RECOVER_LABEL}', 1)) AS b FROM notices) SELECT notice_id, CASE WHEN a <> '' THEN 0.85 WHEN length(b) BETWEEN 2 AND 350 THEN 0.80 END AS confidence, CASE WHEN a <> '' THEN a WHEN length(b) BETWEEN 2 AND 350 THEN b END AS value FROM r")
def st31(spark, d):
    """A missing field by pattern, else by its label: ISO dates match the pattern."""
    return n.notices(spark, d).select("notice_id", tx.recovered(c("text"), [RECOVER_PATTERN], ["Last Date"]).alias("r")).select("notice_id", c("r.confidence").alias("confidence"), "r.value")


# filters and pages


@query("pf12_quality_gate", "SELECT doc_id, passed FROM (SELECT doc_id, length(text) >= 400 AS passed FROM documents)")
def pf12(spark, d):
    good, bad = filters.split_by_gate(table(spark, d, "documents").select("doc_id", F.char_length("text").alias("n")), c("n") >= 400)
    return good.select("doc_id", F.lit(True).alias("passed")).unionByName(bad.select("doc_id", F.lit(False).alias("passed")))


CLAIMED = "CASE notice_id % 5 WHEN 0 THEN upper(substr(text, 1, 12)) WHEN 1 THEN 'zebra unicorn sighting' WHEN 2 THEN 'ref T ' || CAST(notice_id AS STRING) WHEN 3 THEN 'turnover experience zebra contact' ELSE ' ' END"


@query("pf13_grounded", with_("notices") + rf""", s AS (SELECT notice_id, lower(trim({CLAIMED})) AS v, lower(text) AS p FROM notices), q AS (SELECT *, regexp_replace(v, '[^a-z0-9]', '', 'g') AS vq, regexp_replace(p, '[^a-z0-9]', '', 'g') AS pq, list_filter(string_split_regex(v, '[^a-z0-9]+'), lambda w: length(w) >= 4) AS ws FROM s)
    SELECT notice_id, v <> '' AND (contains(p, v) OR vq <> '' AND contains(pq, vq) OR len(list_filter(regexp_extract_all(v, '\d{{2,}}'), lambda x: contains(pq, x))) > 0 OR len(ws) > 0 AND len(list_filter(ws, lambda w: contains(p, w))) >= 0.6 * len(ws)) AS grounded FROM q""")
def pf13(spark, d):
    """Whether a claim is borne out by its notice: as text, without its spaces, by its digits, by its words, or not."""
    return n.notices(spark, d).select("notice_id", filters.grounded(F.expr(CLAIMED), c("text")).alias("grounded"))


MIME = "CASE p_partkey % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'image/png' WHEN 3 THEN '' WHEN 4 THEN 'application/octet-stream' ELSE 'text/plain' END"
FILE_NAME = "p_name || CASE p_partkey % 7 WHEN 0 THEN '.bin' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.txt' WHEN 4 THEN '.docx' WHEN 5 THEN '' ELSE '.tar.tif' END"


@query("sc03_file_types", rf"""WITH f AS (SELECT p_partkey, {MIME} AS m, lower(regexp_extract({FILE_NAME}, '\.([A-Za-z0-9]+)$', 1)) AS e FROM part) SELECT p_partkey, CASE WHEN m = 'application/pdf' THEN 'pdf' WHEN contains(m, 'wordprocessingml') THEN 'docx' WHEN starts_with(m, 'image/') THEN 'image'
    WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('doc', 'docx') THEN 'docx' WHEN e IN ('png', 'jpg', 'jpeg', 'tif', 'tiff') THEN 'image' ELSE 'unknown' END AS kind FROM f""")
def sc03(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.file_type(F.expr(MIME), F.expr(FILE_NAME)).alias("kind"))


@query("sc06_pages_in_order", with_("notices") + "SELECT notice_id // 30 AS doc, string_agg(page_number, ',' ORDER BY page_number) AS pages FROM notices GROUP BY 1")
def sc06(spark, d):
    at = n.notices(spark, d).groupBy(F.floor(c("notice_id") / 30).alias("doc")).agg(F.array_sort(F.collect_list("page_number")).alias("p"))
    return at.select("doc", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


@query("sc09_scanned", "SELECT conv_id, round(avg(CASE WHEN length(coalesce(text, '')) < 140 THEN 1.0 ELSE 0 END), 4) AS sparse_share, avg(CASE WHEN length(coalesce(text, '')) < 140 THEN 1.0 ELSE 0 END) >= 0.6 AS is_scanned FROM conversations GROUP BY 1")
def sc09(spark, d):
    """Conversations most of whose turns have under 140 characters, as a scanned document's pages have under 40."""
    return docs.scanned(table(spark, d, "conversations").select("conv_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("char_count")), "conv_id", least=140)


@query("sc10_pagination", r"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '\f|\n{3,}'), lambda x: trim(x) <> '') AS marks, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws, greatest(1, ceil(length(text) / 3000.0))::BIGINT AS parts FROM documents),
    q AS (SELECT *, greatest(1, ceil(len(ws) / parts::DOUBLE))::BIGINT AS per FROM p)
    SELECT doc_id, CASE WHEN len(marks) > 1 THEN len(marks) ELSE ceil(len(ws) / per::DOUBLE)::BIGINT END AS pages, CASE WHEN len(marks) > 1 THEN md5(marks[2]) WHEN len(ws) > per THEN md5(array_to_string(ws[per + 1:2 * per], ' ')) END AS second FROM q WHERE len(marks) > 1 OR len(ws) > 0""")
def sc10(spark, d):
    """Pages of all documents, by their marks or in even slices of words, and the second page's digest; without words there is no page."""
    pages = docs.paginate(table(spark, d, "documents"), "doc_id", "text")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max(F.when(c("page_number") == 2, F.md5("text"))).alias("second"))


@query("a15_scan_quality", """SELECT conv_id, pages, avg_chars, round(coverage, 4) AS coverage, floor(least(100, coverage * 55 + least(1, avg_chars / 2000.0) * 45) + 0.5)::BIGINT AS score FROM (SELECT conv_id, count(*) AS pages, floor(avg(length(coalesce(text, ''))) + 0.5) AS avg_chars,
    avg(CASE WHEN length(coalesce(text, '')) >= 40 THEN 1.0 ELSE 0 END) AS coverage FROM conversations GROUP BY 1)""")
def a15(spark, d):
    return docs.scan_quality(table(spark, d, "conversations").select("conv_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("char_count")), "conv_id")


@query("a23_repeated_lines", f"WITH p AS (SELECT DISTINCT doc_id % 5 AS doc, doc_id AS page, lower(trim(unnest(string_split(text, chr(10))))) AS line FROM documents) SELECT doc, line, count(*) AS pages FROM p WHERE length(line) BETWEEN 8 AND 120 AND NOT {NOISE_SQL.replace('@', 'line')} GROUP BY 1, 2 HAVING count(*) >= 3")
def a23(spark, d):
    pages = table(spark, d, "documents").select((c("doc_id") % 5).alias("doc"), c("doc_id").alias("page"), "text")
    return docs.repeated_lines(pages, "doc", "page", "text")


@query("a24_frequent_lines", f"WITH {DOC_LINES}, t AS (SELECT doc_id, greatest(4, floor(count(*) / 200.0)) AS need FROM good GROUP BY 1) SELECT g.doc_id, g.line, count(*) AS n FROM good g JOIN t USING (doc_id) WHERE length(g.line) BETWEEN 6 AND 120 GROUP BY 1, 2 HAVING count(*) >= any_value(t.need)")
def a24(spark, d):
    return docs.frequent_lines(table(spark, d, "documents"), "doc_id", "text")


@query("j11_context", "SELECT c.conv_id, c.turn, sum(length(substr(o.text, 1, 3000))) + count(*) - 1 AS chars FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn BETWEEN c.turn - 1 AND c.turn + 1 GROUP BY 1, 2")
def j11(spark, d):
    return docs.context(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", F.char_length("context").cast("long").alias("chars"))


@query("l06_collated_order", with_("fields") + "SELECT min(certificates) AS value, count(*) AS n, row_number() OVER (ORDER BY lower(certificates)) AS place FROM fields GROUP BY lower(certificates)")
def l06(spark, d):
    """Different values in dictionary order, whatever their case, by a collation; only the different ones are sorted."""
    values = n.fields(spark, d).groupBy(F.collate("certificates", "UNICODE_CI").alias("v")).agg(F.min("certificates").alias("value"), F.count("*").alias("n"))
    return values.select("value", "n", F.row_number().over(Window.orderBy("v")).cast("long").alias("place"))


@query("s06_deduped_lists", """WITH i AS (SELECT DISTINCT p_brand, p_size, unnest([lower(p_name), lower(p_type)]) AS x FROM part WHERE p_type IS NOT NULL),
    k AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM i AS o WHERE o.p_brand = i.p_brand AND o.p_size = i.p_size AND o.x <> i.x AND contains(o.x, i.x) AND length(o.x) <= 25 AND length(i.x) <= 25))
    SELECT p_brand, p_size, string_agg(x, '|' ORDER BY x) AS kept FROM k GROUP BY 1, 2""")
def s06(spark, d):
    """Lists without repeats and without short texts inside others, the longer kept: a part's type goes where a name holds it."""
    items = table(spark, d, "part").where("p_type is not null").select("p_brand", "p_size", F.explode(F.array(F.lower("p_name"), F.lower("p_type"))).alias("x"))
    lists = items.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("x")).alias("l"))
    return lists.select("p_brand", "p_size", F.array_join(F.array_sort(tx.deduped(c("l"), 200)), "|").alias("kept"))


# dates and money


@query("d02_dates", with_("fields") + r""", p AS (SELECT notice_id, trim(last_date) AS t FROM fields),
    q AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}') THEN [TRY_CAST(regexp_extract(t, '^(\d{4})', 1) AS INT), TRY_CAST(regexp_extract(t, '^\d{4}-(\d{1,2})', 1) AS INT), TRY_CAST(regexp_extract(t, '^\d{4}-\d{1,2}-(\d{1,2})', 1) AS INT)]
      WHEN regexp_matches(t, '^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$') THEN [TRY_CAST(regexp_extract(t, '(\d+)$', 1) AS INT), TRY_CAST(regexp_extract(t, '^\d+[/.\-](\d+)', 1) AS INT), TRY_CAST(regexp_extract(t, '^(\d+)', 1) AS INT)]
      WHEN regexp_matches(t, '(?i)^\d{1,2}\s+[a-z]{3}[a-z]*\.?,?\s+\d{2,4}$') THEN [TRY_CAST(regexp_extract(t, '(\d+)$', 1) AS INT), list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(regexp_extract(t, '(?i)^\d+\s+([a-z]{3})', 1))), TRY_CAST(regexp_extract(t, '^(\d+)', 1) AS INT)] END AS ymd FROM p),
    r AS (SELECT *, CASE WHEN ymd[1] >= 100 THEN ymd[1] WHEN ymd[1] >= 70 THEN 1900 + ymd[1] ELSE 2000 + ymd[1] END AS y, CASE WHEN ymd[2] > 12 AND ymd[3] <= 12 THEN ymd[3] ELSE ymd[2] END AS m, CASE WHEN ymd[2] > 12 AND ymd[3] <= 12 THEN ymd[2] ELSE ymd[3] END AS d FROM q),
    x AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS day FROM r)
    SELECT notice_id, CASE WHEN y BETWEEN 1900 AND 2100 THEN strftime(day, '%Y-%m-%d') END AS day, CASE WHEN ymd IS NULL THEN 'unrecognised' WHEN day IS NULL OR y NOT BETWEEN 1900 AND 2100 THEN 'impossible_date' END AS reason FROM x""")
def d02(spark, d):
    return n.fields(spark, d).select("notice_id", dates.normalize_date(c("last_date")).alias("r")).select("notice_id", c("r.value").alias("day"), "r.reason")


FLEXIBLE = "CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0') WHEN 2 THEN CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING) || '-' || CAST(year(o_orderdate) AS STRING) WHEN 3 THEN '31 June 2021' WHEN 4 THEN '15.14.2021' ELSE '7 Sept ' || CAST(year(o_orderdate) AS STRING) END"


@query("d03_flexible_dates", rf"""WITH t AS (SELECT o_orderkey, {FLEXIBLE} AS t FROM orders),
    p AS (SELECT *, regexp_matches(t, '^\d{{4}}-') AS iso, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(regexp_extract(t, '^\d+ ([A-Za-z]{{3}})', 1))) AS named, TRY_CAST(regexp_extract(t, '^(\d+)', 1) AS INT) AS a, TRY_CAST(regexp_extract(t, '^\d+[/.\-](\d+)', 1) AS INT) AS b, TRY_CAST(regexp_extract(t, '(\d+)$', 1) AS INT) AS y FROM t),
    q AS (SELECT *, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS yy, CASE WHEN named > 0 THEN named WHEN b > 12 AND a <= 12 THEN a ELSE b END AS m, CASE WHEN coalesce(named, 0) = 0 AND b > 12 AND a <= 12 THEN b ELSE a END AS d FROM p)
    SELECT o_orderkey, t AS raw, strftime(CASE WHEN iso THEN TRY_CAST(t AS DATE) WHEN m BETWEEN 1 AND 12 THEN make_date(yy, m, 1) + (d - 1)::INT END, '%Y-%m-%d') AS day FROM q""")
def d03(spark, d):
    """Dates of certificates: ISO, numbers, month names; a day beyond its month runs over into the next."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{FLEXIBLE} AS raw")
    return rows.select("o_orderkey", "raw", F.date_format(dates.flexible_date(c("raw")), "yyyy-MM-dd").alias("day"))


@query("d04_latest_expiry", with_("fields") + "SELECT o_orderkey AS notice_id, strftime(greatest(o_orderdate::DATE, DATE '1996-06-30'), '%Y-%m-%d') AS expiry, CASE WHEN greatest(o_orderdate::DATE, DATE '1996-06-30') < DATE '1998-01-01' THEN 'error' WHEN greatest(o_orderdate::DATE, DATE '1996-06-30') <= DATE '1998-01-31' THEN 'warning' ELSE 'ok' END AS level FROM orders")
def d04(spark, d):
    """The latest date in a certificate's text: past is an error, within 30 days a warning."""
    text = F.concat(F.lit("valid to 30/06/1996, renewed to "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    day = dates.latest_date(text)
    return table(spark, d, "orders").select(c("o_orderkey").alias("notice_id"), F.date_format(day, "yyyy-MM-dd").alias("expiry"), dates.expiry_check(day, F.lit("1998-01-01").cast("date")).alias("level"))


@query("d06_fiscal_years", "SELECT y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS fiscal_year, count(*) AS n FROM (SELECT year(o_orderdate) - (month(o_orderdate) < 4)::INT AS y FROM orders) GROUP BY 1")
def d06(spark, d):
    return table(spark, d, "orders").groupBy(dates.fiscal_year_label(dates.fiscal_year_start(c("o_orderdate"))).alias("fiscal_year")).agg(F.count("*").alias("n"))


_UNIT = r"CASE WHEN regexp_extract(completion_period, '(?i)(\d+(?:\.\d+)?)\s*{0}', 1) <> '' THEN CAST(regexp_extract(completion_period, '(?i)(\d+(?:\.\d+)?)\s*{0}', 1) AS DOUBLE) {1} END"


@query("d07_d08_durations", with_("fields") + rf"SELECT notice_id, coalesce({_UNIT.format('year', '* 12')}, {_UNIT.format('month', '')}, {_UNIT.format('week', '/ 4')}, {_UNIT.format('day', '/ 30')}) AS months, coalesce(TRY_CAST(regexp_extract(experience, '(?i)(\d+)\s*(?:year|yr)', 1) AS BIGINT), 0) AS years FROM fields")
def d07(spark, d):
    return n.fields(spark, d).select("notice_id", dates.duration_months(c("completion_period")).alias("months"), dates.experience_years(c("experience")).cast("long").alias("years"))


@query("m01_parse_amount", with_("fields") + f"SELECT notice_id, round({AMOUNT_SQL.format('emd_amount')}, 2) AS emd, round({AMOUNT_SQL.format('estimated_cost')}, 2) AS cost FROM fields")
def m01(spark, d):
    return n.fields(spark, d).select("notice_id", F.round(money.parse_amount(c("emd_amount")), 2).alias("emd"), F.round(money.parse_amount(c("estimated_cost")), 2).alias("cost"))


@query("m02_m05_amount_rules", with_("fields") + f"""SELECT notice_id, CASE WHEN length(regexp_replace(emd_amount, '\\D', '', 'g')) BETWEEN 4 AND 15 THEN CAST(regexp_replace(emd_amount, '\\D', '', 'g') AS DOUBLE) END AS digits, coalesce(abs(a - 0.02 * b) / abs(0.02 * b) * 100 <= 5, false) AS near, coalesce(b <= 0 OR a <= 0.2 * b, true) AS sane
    FROM (SELECT notice_id, regexp_replace(emd_amount, '\\.\\d{{1,2}}\\b', '', 'g') AS emd_amount, {AMOUNT_SQL.format('emd_amount')} AS a, {AMOUNT_SQL.format('estimated_cost')} AS b FROM fields)""")
def m02(spark, d):
    """Rules of all deposits; one without an amount is near nothing and within bounds."""
    f = n.fields(spark, d).withColumns({"a": money.parse_amount(c("emd_amount")), "b": money.parse_amount(c("estimated_cost"))})
    near, sane = money.within_percent(c("a"), 0.02 * c("b")), money.sane_deposit(c("a"), c("b"))
    return f.select("notice_id", money.digits_amount(c("emd_amount")).alias("digits"), F.coalesce(near, F.lit(False)).alias("near"), F.coalesce(sane, F.lit(True)).alias("sane"))


@query("m03_m06_display", "SELECT o_orderkey, least(98, greatest(35, floor(o_totalprice / 4000 + 0.5))) AS clamped, CASE WHEN v >= 1e7 THEN printf('%.2f Cr', v / 1e7) WHEN v >= 1e5 THEN printf('%.2f L', v / 1e5) ELSE printf('%.2f', v) END AS shown FROM (SELECT *, floor(o_totalprice) * 64 AS v FROM orders)")
def m03(spark, d):
    return table(spark, d, "orders").select("o_orderkey", money.clamped(c("o_totalprice") / 4000, 35, 98).cast("double").alias("clamped"), money.display(F.floor("o_totalprice").cast("double") * 64).alias("shown"))
