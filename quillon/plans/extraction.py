"""Fields found in the pages of dossiers: located by labels, named by registries, read from lines and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import sections as se
from quillon.functions import text as tx
from quillon.operators import locate as lo
from quillon.operators import mapping
from quillon.operators import parameters as pm
from quillon.operators import tables as tb
from quillon.plans.registry import query
from quillon.plans.texts import REASON_SQL, TIGHT_SQL
from quillon.sources import dossiers as ds

c = F.col
WITH = "WITH " + ds.SQL


def _values(items) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in item) + ")" for item in items)


def _hits_sql(name: str, labels, short: int, whole: str) -> str:
    """Occurrences of labels with an amount behind them, as SQL: a text split at a label tells where the label stands."""
    return f""", {name}_cut AS (SELECT doc_id, page, text, label, priority, string_split(low, translate(label, '{lo.UPPER}', '{lo.LOWER}')) AS parts
      FROM (SELECT *, translate(text, '{lo.UPPER}', '{lo.LOWER}') AS low FROM dossiers), (VALUES {_values((t, k) for k, t in enumerate(labels, 1))}) AS v(label, priority)),
    {name}_at AS (SELECT doc_id, page, text, label, priority, unnest(list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[:i], lambda p: length(p))) + (i - 1) * length(label))::INT)) AS spot FROM {name}_cut),
    {name}_part AS (SELECT *, regexp_extract(substr(text, spot + length(label) + 1, {lo.FOLLOWS}), '{lo.AMOUNT}', 1) AS part, spot + length(label) // 2 AS center FROM {name}_at
      WHERE (spot = 0 OR NOT regexp_matches(substr(text, spot, 1), '^\\w$') OR length(label) >= {short}) AND (NOT regexp_matches(substr(text, spot + length(label) + 1, 1), '^\\w$') OR label <> '{whole}')),
    {name} AS (SELECT doc_id, page, label, priority, spot, part, CAST(replace(part, ',', '') AS DOUBLE) AS value,
      trim(regexp_replace(substr(text, greatest(center - {lo.RADIUS}, 0) + 1, least(length(text), center + {lo.RADIUS}) - greatest(center - {lo.RADIUS}, 0)), '\\s+', ' ', 'g')) AS context,
      CASE WHEN page <= 10 THEN 100 WHEN page <= 20 THEN 50 ELSE 10 END AS weight FROM {name}_part WHERE length(replace(part, ',', '')) >= 4)"""


def _first_sql(pattern: str) -> str:
    return f"arg_min(TRY_CAST(replace(regexp_extract(text, '{pattern}', 1), ',', '') AS DOUBLE), page) FILTER (regexp_extract(text, '{pattern}', 1) <> '')"


_BONUS = "CASE WHEN {0} <= 2 THEN 15 WHEN {0} <= 5 THEN 10 ELSE 0 END"
DEPOSITS = _hits_sql("hits", lo.DEPOSIT_LABELS, 12, "EMD")


@query("st25_deposits", WITH + DEPOSITS + f""", facts AS (SELECT doc_id, {_first_sql(lo.STATED_VALUE)} AS stated, {_first_sql(lo.DEPOSIT_PERCENT)} AS percent FROM dossiers GROUP BY 1),
    judged AS (SELECT hits.*, floor(stated * percent / 100 + 0.5) AS expected, coalesce(NOT regexp_matches(context, '{lo.DEPOSIT_REJECT}') AND regexp_matches(context, '{lo.DEPOSIT_CONTEXT}')
        AND NOT coalesce(stated > 0 AND value > stated * 0.2, false) AND NOT (priority >= 7 AND page > 20 AND NOT regexp_matches(context, '{lo.DEPOSIT_STRONG}')), false) AS accepted FROM hits JOIN facts USING (doc_id)),
    fit AS (SELECT *, coalesce(expected > 0 AND abs(value - expected) / expected <= 0.05, false) AS fits FROM judged),
    best AS (SELECT * FROM fit WHERE accepted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, weight DESC, page, spot) = 1),
    good AS (SELECT * FROM fit WHERE accepted AND fits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, priority, spot) = 1),
    weak AS (SELECT * FROM fit WHERE fits AND doc_id NOT IN (SELECT doc_id FROM best) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, priority, spot) = 1),
    said AS (SELECT b.doc_id, CASE WHEN g.part IS NULL THEN 'explicit_statement' WHEN g.part = b.part OR g.priority <= 4 THEN 'percentage_validated' ELSE 'explicit_statement' END AS rule,
        CASE WHEN g.part <> b.part AND g.priority <= 4 THEN g.part ELSE b.part END AS part, CASE WHEN g.part <> b.part AND g.priority <= 4 THEN g.page ELSE b.page END AS page, CASE WHEN g.part <> b.part AND g.priority <= 4 THEN g.label ELSE b.label END AS label
      FROM best b LEFT JOIN good g USING (doc_id) UNION ALL SELECT doc_id, 'percentage_rule', part, page, label FROM weak)
    SELECT doc_id, 'Rs. ' || part AS amount, page, label, CASE WHEN rule = 'explicit_statement' THEN least(100, 92 + {_BONUS.format('page')}) ELSE 100 END AS confidence, rule FROM said""")
def st25_deposits(spark, d):
    return lo.located_deposits(ds.dossiers(spark, d))


@query("st25_values", WITH + DEPOSITS.replace("hits", "dep") + _hits_sql("hits", lo.VALUE_LABELS, 1000, "") + f""", percent AS (SELECT doc_id, {_first_sql(lo.DEPOSIT_PERCENT)} AS percent FROM dossiers GROUP BY 1),
    paid AS (SELECT doc_id, arg_min(value, (priority, page, spot)) AS deposit FROM dep WHERE value > 0 AND value < 5e8 GROUP BY 1), facts AS (SELECT doc_id, floor(deposit * 100 / percent + 0.5) AS expected FROM paid JOIN percent USING (doc_id) WHERE percent > 0),
    good AS (SELECT hits.*, coalesce(expected > 0 AND abs(value - expected) / expected <= 0.05, false) AS fits FROM hits LEFT JOIN facts USING (doc_id) WHERE NOT regexp_matches(context, '{lo.VALUE_REJECT}') AND regexp_matches(context, '{lo.VALUE_CONTEXT}'))
    SELECT doc_id, 'Rs. ' || part AS amount, page, label, CASE WHEN fits THEN 100 ELSE least(100, 92 + {_BONUS.format('page')}) END AS confidence, CASE WHEN fits THEN 'emd_cross_validated' ELSE 'explicit_statement' END AS rule
    FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT fits, CASE WHEN fits THEN page END, CASE WHEN fits THEN priority END, CASE WHEN fits THEN spot END, priority, weight DESC, page, spot) = 1""")
def st25_values(spark, d):
    return lo.located_values(ds.dossiers(spark, d))


#: Labels of a work's name, and what ends it; fixed values.
WORK_LABELS, WORK_STOPS = ("Name of Work", "Scope of Work", "Contact Officer"), r"\bEMD\b|\bTender\b|\bEstimated\b|\bBid\b|\bNIT\b|\bLast date\b|\bANNEXURE\b|\n\n"


@query("st25_work_names", WITH + f""", cut AS (SELECT doc_id, page, text, label, string_split(translate(text, '{lo.UPPER}', '{lo.LOWER}'), lower(label)) AS parts FROM dossiers, (VALUES {_values((x,) for x in WORK_LABELS)}) AS v(label)),
    places AS (SELECT doc_id, page, text, label, unnest(list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[:i], lambda p: length(p))) + (i - 1) * length(label))::INT)) AS spot FROM cut),
    tails AS (SELECT doc_id, page, label, spot, regexp_replace(substr(text, spot + length(label) + 1), '^[\\s:.\\-–—]*', '') AS tail FROM places WHERE (spot = 0 OR NOT regexp_matches(substr(text, spot, 1), '^\\w$')) AND NOT regexp_matches(substr(text, spot + length(label) + 1, 1), '^\\w$')),
    blocks AS (SELECT doc_id, page, spot, label, trim(regexp_replace(regexp_replace(regexp_replace(substr(tail, 1, 500), '(?is)(?:{WORK_STOPS}).*$', ''), '[,–—\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM tails)
    SELECT doc_id, value, page, least(100, CASE label WHEN 'Name of Work' THEN 95 ELSE 85 END + {_BONUS.format('page')}) AS confidence FROM blocks WHERE length(value) BETWEEN 8 AND 500 AND len(string_split(value, ' ')) <= 80
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, length(value) DESC, page, spot) = 1""")
def st25_work_names(spark, d):
    return lo.located_blocks(ds.dossiers(spark, d), WORK_LABELS, "name of work", WORK_STOPS)


#: Labels and patterns of what a text says without a model.
NUMBER_PATTERNS = (r"(?i)tender\s*(?:no|number|id|ref)[.:\s]*([A-Z0-9/\-]+)", r"(?i)nit\s*(?:no|number)[.:\s]*([A-Z0-9/\-]+)", r"(?i)e-?tender\s*(?:no|id)[.:\s]*([A-Z0-9/\-]+)")
AUTHORITY_PATTERNS = (
    r"(?i)(?:tender(?:ing)? authority|issuing authority|name of (?:work|department|organisation|organization))[:\s]+([^\n]{3,100})",
    r"(?i)(?:organization|organisation|authority|department|issued by|invited by)[:\s]+([^\n]{3,100})",
)
DATE_PATTERNS = (r"(?i)(?:submission date|bid submission|last date(?: for| of)? submission|due date)[^:\n]*[:\s]+([^\n]{4,50})", r"(?i)last date[^:\n]*[:\s]+([^\n]{4,50})")
DURATION_PATTERNS = (
    r"(?i)(?:completion time|time for completion|contract period|contract duration|period of completion)[^:\n]*[:\s]+([^\n]{4,80})",
    r"(?i)(?:within|in)\s+(\d+\s*(?:days|months|weeks)(?:\s+from[^.\n]{0,30})?)", r"(?i)completion[^:\n]*[:\s]+([^\n]{4,60})",
)
VALUE_NAMES = ("estimated contract value", "estimated value", "tender value", "contract value", "approximate value", "cost of work", "value of work")
DEPOSIT_NAMES = ("emd amount", "emd", "earnest money deposit", "earnest money", "bid security", "tender fee")
GUARANTEE_NAMES = ("performance bank guarantee", "performance guarantee", "bank guarantee", "security deposit", "PBG")
GUARANTEE_LINE, GUARANTEE_WORD = r"(?i)(?:bank guarantee|performance guarantee|bg|PBG)\s*(?:required|amount|of)?[^:\n]{0,30}[:\s]+([^\n]{3,100})", r"(?i)\bbank guarantee\b|\bperformance guarantee\b|\bPBG\b"
AUCTION_WORDS = ("reverse auction", "e-reverse auction", "e-auction", "online auction")
MAKER_WORDS = ("maf", "manufacturer authorization", "manufacturer authorisation", "authorization form", "authorisation form")
DOCUMENT_WORDS = ("required documents", "documents to be submitted", "documents required", "bid documents", "enclosures")


def _coalesced(found: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif({f}, '')" for f in found) + ", '')"


def _pattern_sql(patterns) -> str:
    return _coalesced([f"trim(regexp_replace(regexp_extract(text, '{p}', 1), '\\s+', ' ', 'g'))" for p in patterns])


def _amount_sql(labels) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(text, '{p.format(x)}', 1) <> '' THEN trim(regexp_extract(text, '{p.format(x)}', 1)) END" for x in labels for p in (lo.NEAR_AMOUNT, lo.COLON_AMOUNT)) + ", '')"


def _answer_sql(words) -> str:
    ways = []
    for w in words:
        said = f"lower(regexp_extract(text, '{lo.ANSWER.format(w)}', 1))"
        ways += [f"CASE WHEN {said} IN ('yes', 'required', 'applicable') THEN 'Yes' WHEN {said} IN ('no', 'not required', 'not applicable') THEN 'No' END", f"CASE WHEN regexp_matches(text, '{lo.MANDATORY.format(w)}') THEN 'Yes' END"]
    return f"coalesce({', '.join(ways)}, 'No')"


@query("st28_first_patterns", WITH + f"SELECT doc_id, page, {_pattern_sql(NUMBER_PATTERNS)} AS number, {_pattern_sql(AUTHORITY_PATTERNS)} AS authority, {_pattern_sql(DATE_PATTERNS)} AS due, {_pattern_sql(DURATION_PATTERNS)} AS duration FROM dossiers")
def st28_patterns(spark, d):
    t = c("text")
    return ds.dossiers(spark, d).select(
        "doc_id", "page", lo.first_pattern(t, NUMBER_PATTERNS).alias("number"), lo.first_pattern(t, AUTHORITY_PATTERNS).alias("authority"),
        lo.first_pattern(t, DATE_PATTERNS).alias("due"), lo.first_pattern(t, DURATION_PATTERNS).alias("duration"))


@query("st28_near_amounts", WITH + f""", a AS (SELECT doc_id, page, text, {_amount_sql(VALUE_NAMES)} AS value, {_amount_sql(DEPOSIT_NAMES)} AS deposit, {_amount_sql(GUARANTEE_NAMES)} AS guarantee FROM dossiers)
    SELECT doc_id, page, value, deposit, coalesce(nullif(guarantee, ''), nullif(trim(regexp_extract(text, '{GUARANTEE_LINE}', 1)), ''), CASE WHEN regexp_matches(text, '{GUARANTEE_WORD}') THEN 'Yes' ELSE '' END) AS guarantee FROM a""")
def st28_amounts(spark, d):
    t = c("text")
    line = F.trim(F.regexp_extract(t, GUARANTEE_LINE, 1))
    near = lo.near_amount(t, GUARANTEE_NAMES)
    guarantee = F.coalesce(F.when(near != "", near), F.when(line != "", line), F.when(t.rlike(GUARANTEE_WORD), "Yes").otherwise(""))
    return ds.dossiers(spark, d).select("doc_id", "page", lo.near_amount(t, VALUE_NAMES).alias("value"), lo.near_amount(t, DEPOSIT_NAMES).alias("deposit"), guarantee.alias("guarantee"))


@query("st28_answers", WITH + f"SELECT doc_id, page, {_answer_sql(AUCTION_WORDS)} AS auction, {_answer_sql(MAKER_WORDS)} AS maker FROM dossiers")
def st28_answers(spark, d):
    yes_no = lambda words: F.coalesce(F.nullif(lo.answer(c("text"), words), F.lit("")), F.lit("No"))
    return ds.dossiers(spark, d).select("doc_id", "page", yes_no(AUCTION_WORDS).alias("auction"), yes_no(MAKER_WORDS).alias("maker"))


@query("st28_list_items", WITH + f""", k AS (SELECT doc_id, page, k, list_transform(string_split_regex(substr(text, strpos(translate(text, '{lo.UPPER}', '{lo.LOWER}'), word), 1200), '{lo.ITEM_BREAK}'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS items
      FROM dossiers, (VALUES {_values(enumerate(DOCUMENT_WORDS))}) AS v(k, word) WHERE contains(translate(text, '{lo.UPPER}', '{lo.LOWER}'), word)),
    six AS (SELECT doc_id, page, k, list_filter(items, lambda x: length(x) BETWEEN 4 AND 179 AND NOT regexp_matches(x, '(?i)^page\\s+\\d'))[:6] AS items FROM k)
    SELECT doc_id, page, k, i, items[i] AS item FROM (SELECT *, unnest(generate_series(1, len(items))) AS i FROM six)""")
def st28_items(spark, d):
    """Items behind each keyword of a section, the first six of each."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), lo.listed(c("text"), (w,)).alias("items")) for k, w in enumerate(DOCUMENT_WORDS)]))
    rows = ds.dossiers(spark, d).select("doc_id", "page", each.alias("e"))
    return rows.select("doc_id", "page", "e.k", F.posexplode("e.items").alias("i", "item")).withColumn("i", (c("i") + 1).cast("long"))


# names mapped to fields


#: Rules of fields by their aliases: each subject of a tender with each of its sides, in the wordings that documents have.
SUBJECTS = {"tender": "Tender", "bid": "Bid", "contract": "Contract", "nit": "Notice", "work": "Work", "deposit": "Deposit", "emd": "Deposit", "earnest money": "Deposit", "payment": "Payment", "warranty": "Warranty", "insurance": "Insurance", "inspection": "Inspection"}
SIDES = {"Number": ("no", "no.", "number", "id", "reference no", "reference number"), "Value": ("value", "amount", "cost"), "Period": ("period", "duration", "time", "validity"), "Terms": ("terms", "conditions"), "Place": ("place", "location", "site")}
RULES = [(f"{field} {side}", sorted({f"{s} {w}" for s, f in SUBJECTS.items() if f == field for w in words} | {f"{w} of {s}" for s, f in SUBJECTS.items() if f == field for w in words})) for field in dict.fromkeys(SUBJECTS.values()) for side, words in SIDES.items()]
RULES += [("Deposit Value", ["emd", "earnest money", "bid security", "security deposit"]), ("Contact", ["contact officer", "officer", "email"]), ("Work Name", ["name of work", "scope of work"]), ("Completion", ["period of completion", "completion period", "completion"])]
EXACT = [("emd", "Deposit Value"), ("bid no", "Tender Number"), ("tender fee", "Tender Fee"), ("validity of bid", "Bid Period")]
ORDERED = sorted(RULES, key=lambda r: -max(map(len, r[1])))
REGISTRY_SQL = ", aliases AS (SELECT alias, min(rule) AS rule, arg_min(target, rule) AS target FROM (VALUES " + _values((a, k, t) for k, (t, aliases) in enumerate(ORDERED) for a in aliases) + ") AS v(alias, rule, target) GROUP BY alias)"
#: The names of a dossier's lines: what stands before a colon, a pipe, a tab or an equals sign, or before two spaces.
NAME = r"^[^A-Za-z]*([A-Za-z][A-Za-z0-9 .&()/\-]*?)\s*(?:[:|\t=]|\s\s)"
PAIRS_SQL = f""", said AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM dossiers),
    pairs AS (SELECT doc_id, page, place, trim(regexp_replace(lower(regexp_extract(line, '{NAME}', 1)), '\\s+', ' ', 'g')) AS name, trim(regexp_replace(line, '{NAME}', '')) AS value, 70 + place % 3 AS confidence FROM said WHERE regexp_matches(line, '{NAME}'))"""


def pairs(spark, d):
    lines = ds.dossiers(spark, d).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("place", c("place") + 1).where(c("line").rlike(NAME))
    name = F.trim(F.regexp_replace(F.lower(F.regexp_extract("line", NAME, 1)), r"\s+", " "))
    return lines.select("doc_id", "page", "place", name.alias("name"), F.trim(F.regexp_replace("line", NAME, "")).alias("value"), (70 + c("place") % 3).alias("confidence"))


@query("st24_field_mapping", WITH + PAIRS_SQL + REGISTRY_SQL + f""", n AS (SELECT DISTINCT name FROM pairs WHERE name <> ''),
    m AS (SELECT name, 1 AS way, rule, target FROM n, aliases WHERE name = alias OR starts_with(name, alias || ' ') OR starts_with(name, alias || ':') OR regexp_matches(name, '(?:^|[\\s:–\\-])' || regexp_escape(alias) || '(?:\\s|:|$)')
      UNION ALL SELECT name, 0, 0, target FROM n JOIN (VALUES {_values(EXACT)}) AS e(name, target) USING (name))
    SELECT name, arg_min(target, (way, rule)) AS target, min(way) AS way FROM m GROUP BY name""")
def st24(spark, d):
    exact = spark.createDataFrame(EXACT, "name string, target string")
    return mapping.mapped_names(pairs(spark, d), mapping.registry(spark, RULES), exact)


@query("st27_label_mapping", WITH + PAIRS_SQL + REGISTRY_SQL + """, n AS (SELECT DISTINCT name FROM pairs WHERE name <> ''),
    m AS (SELECT name, 1 AS way, rule, target FROM n JOIN aliases ON name = alias UNION ALL SELECT name, 2, rule, target FROM n, aliases WHERE length(alias) >= 4 AND starts_with(name, alias || ' ')),
    w AS (SELECT name, arg_min(target, (way, rule)) AS target FROM m GROUP BY name)
    SELECT doc_id, target, value, name, page, confidence FROM pairs JOIN w USING (name) QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY confidence DESC, page, place, value) = 1""")
def st27(spark, d):
    rows = pairs(spark, d)
    return mapping.mapping_winners(rows, mapping.mapped_names(rows, mapping.registry(spark, RULES), anywhere=False, shortest=4).drop("way"))


# parameters of whole pages


def _family_sql(k: int, family: str, pattern: str, cut: bool = True, where: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, page, line, {k} AS ord, '{family}' AS family, 0 AS i, regexp_extract(said, '{p}', 1) AS name, regexp_extract(said, '{p}', 2) AS raw, {cut} AS cut, {pm.FAMILIES[family]} AS base FROM trimmed WHERE CASE WHEN regexp_matches(said, '{pm.NEEDS[family]}') THEN regexp_matches(said, '{p}') ELSE false END AND {where}"


_MARKER, _NEXT = pm.MARKER.replace("'", "''"), pm.NEXT_LABEL.replace("'", "''")
PARAMETERS_SQL = WITH + f""", numbered AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM dossiers),
    trimmed AS (SELECT doc_id, page, line, trim(said) AS said FROM numbered WHERE length(trim(said)) >= 2),
    chained AS (SELECT doc_id, page, line, regexp_extract_all(said, '{_MARKER}', 1) AS names, string_split_regex(said, '{_MARKER}') AS pieces FROM trimmed WHERE CASE WHEN regexp_matches(said, '{pm.NEEDS["chained"]}') THEN regexp_matches(said, '{_MARKER}') ELSE false END),
    tabbed AS (SELECT doc_id, page, line, list_filter(list_transform(string_split(said, chr(9)), lambda x: trim(x)), lambda x: x <> '') AS cells FROM trimmed WHERE contains(said, chr(9))),
    found AS (
      SELECT doc_id, page, line, 0 AS ord, 'chained' AS family, i, names[i] AS name, pieces[i + 1] AS raw, true AS cut, 93 AS base FROM (SELECT *, unnest(generate_series(1, len(names))) AS i FROM chained)
      UNION ALL {_family_sql(1, 'colon', pm.COLON)} UNION ALL {_family_sql(2, 'dash', pm.DASH)}
      UNION ALL SELECT doc_id, page, line, 3, 'tabs', i, cells[2 * i + 1], cells[2 * i + 2], false, CASE len(cells) WHEN 2 THEN 86 ELSE 82 END FROM (SELECT *, unnest(range(0, len(cells) // 2)) AS i FROM tabbed WHERE len(cells) % 2 = 0)
      UNION ALL {_family_sql(4, 'numbered', pm.NUMBERED)} UNION ALL {_family_sql(5, 'spaced', pm.SPACED)} UNION ALL {_family_sql(6, 'dots', pm.DOTS, cut=False)}
      UNION ALL {_family_sql(7, 'pipe', pm.PIPE, cut=False, where="NOT regexp_matches(trim(regexp_extract(said, '" + pm.PIPE + "', 1)), '" + pm.PIPE_HEAD + "')")}),
    early AS (SELECT *, CASE WHEN cut THEN regexp_extract(raw, '(?is)^(.+?)\\s+{_NEXT}', 1) ELSE '' END AS early FROM found),
    ended AS (SELECT * EXCLUDE (raw, cut, early), trim(CASE WHEN early <> '' AND NOT regexp_matches(raw, '(?i)^\\s+{_NEXT}') THEN early ELSE raw END) AS value FROM early),
    clean AS (SELECT * EXCLUDE (name, value), trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\s+', ' ', 'g'), '^[\\d]+[.)\\]]\\s*', ''), '^[(\\[]\\d+[)\\]]\\s*', ''), '^[*•\\-]\\s*', '')) AS name, substr(trim(regexp_replace(value, '\\s+', ' ', 'g')), 1, 1200) AS value FROM ended),
    kept AS (SELECT * FROM clean WHERE length(name) BETWEEN 2 AND 110 AND NOT regexp_matches(name, '{pm.NOISE_NAME}') AND regexp_matches(name, '[A-Za-z]') AND NOT regexp_matches(name, '{pm.ONLY_MONEY}') AND value <> '' AND NOT regexp_matches(value, '{pm.ONLY_RULES}')
      QUALIFY row_number() OVER (PARTITION BY doc_id, page, lower(name), lower(value) ORDER BY line, ord, i) = 1)
    SELECT doc_id, page, family, name, value, least(99, base + CASE WHEN page <= 5 THEN 8 WHEN page <= 15 THEN 4 ELSE 0 END) AS confidence FROM kept"""


@query("st08_page_parameters", PARAMETERS_SQL)
def st08_pages(spark, d):
    """Parameters of whole pages by the families that read single lines; the one that reads across lines is tested beside it."""
    return pm.page_parameters(ds.dossiers(spark, d), tuple(f for f in pm.FAMILIES if f != "anywhere"))


@query("st08_all_families")
def st08_all(spark, d):
    """All families, those across lines too, which look ahead as SQL engines without look-ahead cannot."""
    return pm.page_parameters(ds.dossiers(spark, d))


# tables and candidates of fields


GRID_SQL = f""", raw AS (SELECT doc_id, page, trim(unnest(string_split(text, chr(10)))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM dossiers),
    marked AS (SELECT *, length(said) >= 4 AND regexp_matches(said, '{tb.TABLE_LINE}') AS inside, CASE WHEN length(said) BETWEEN 6 AND 120 AND NOT regexp_matches(said, '{tb.TABLE_LINE}') AND (regexp_matches(said, '{tb.TITLE_WORD}') OR regexp_matches(said, '{tb.TITLE}')) THEN said END AS title FROM raw),
    islands AS (SELECT *, sum((NOT inside)::INT) OVER w AS island, coalesce(lag(title, 1) OVER w, lag(title, 2) OVER w, lag(title, 3) OVER w, lag(title, 4) OVER w, '') AS above FROM marked WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
    celled AS (SELECT doc_id, page, island, line, above, regexp_matches(said, '{tb.HEAD}') AS head, CASE WHEN contains(said, '|') THEN list_filter(list_transform(string_split(said, '|'), lambda x: trim(x)), lambda x: x <> '') WHEN contains(said, chr(9)) THEN list_filter(list_transform(string_split(said, chr(9)), lambda x: trim(x)), lambda x: x <> '')
      ELSE list_filter(list_transform(string_split_regex(said, '\\s{{2,}}'), lambda x: trim(x)), lambda x: x <> '') END AS cells FROM islands WHERE inside),
    blocks AS (SELECT doc_id, page, island, list(cells ORDER BY line) AS rows, min(line)::INT AS spot, arg_min(above, line) AS above, arg_min(head, line) AS head, max(len(cells)) AS width FROM celled GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    named AS (SELECT *, len(rows[1]) >= 2 AND (regexp_matches(array_to_string(rows[1], ' '), '{tb.HEAD}') OR len(list_filter(rows[1], lambda x: length(x) >= 40)) = 0) AS names FROM blocks),
    shaped AS (SELECT doc_id, page, spot, CASE WHEN above <> '' THEN above WHEN head THEN 'Data Table' ELSE '' END AS title, CASE WHEN names THEN rows[1] WHEN width = 2 THEN ['Parameter', 'Value'] ELSE list_transform(range(1, len(rows[1]) + 1), lambda i: 'Col ' || i) END AS columns, width, CASE WHEN names THEN rows[2:] ELSE rows END AS data FROM named),
    grid AS (SELECT doc_id, page, spot, title, columns, i - 1 AS row, list_concat(data[i], list_transform(range(0, width - len(data[i])), lambda k: '')) AS cells FROM (SELECT *, unnest(generate_series(1, len(data))) AS i FROM shaped))"""


@query("st29_table_cells", WITH + GRID_SQL + " SELECT doc_id, page, spot, title, row::INT AS row, col::INT AS col, coalesce(columns[col], '') AS column_name, cells[col] AS said FROM (SELECT *, unnest(generate_series(1, len(cells))) AS col FROM grid)")
def st29_cells(spark, d):
    """Every cell of the tables of all pages, with its row, column and the column's name."""
    rows = tb.page_tables(ds.dossiers(spark, d)).select("doc_id", "page", "spot", "title", "columns", "row", F.posexplode("cells").alias("col", "said")).withColumn("col", c("col") + 1)
    return rows.select("doc_id", "page", "spot", "title", "row", "col", F.coalesce(F.try_element_at("columns", c("col")), F.lit("")).alias("column_name"), "said")


#: Fields: name, labels, synonyms, patterns, hints of their pages, longest value.
FIELDS = [
    ("deposit", ("EMD Amount", "EMD"), ("Earnest Money",), (r"(?i)EMD[^\n]{0,30}?((?:Rs\.?|INR)\s*[\d,]+)",), ("annexure", "deposit"), 120),
    ("period", ("Completion Period", "Contract Period"), ("Period of completion",), (r"(?i)(\d+\s*(?:months|days|weeks))",), ("completion",), 80),
    ("validity", ("Validity",), ("Bid Validity",), (), ("bid",), 60),
]


def _candidates_sql() -> str:
    rows = []
    for name, labels, synonyms, patterns, hints, longest in FIELDS:
        bonus = " + ".join(f"CASE WHEN contains(translate(text, '{lo.UPPER}', '{lo.LOWER}'), '{h.lower()}') THEN {tb.HINT_SCORE} ELSE 0 END" for h in hints)
        every = [(p, "pattern", tb.PATTERN_SCORE) for p in patterns] + [(rf"(?i){x}[^:\n]{{0,{tb.LABEL_REACH}}}[:\s]+([^\n]{{2,{longest}}})", "label", tb.LABEL_SCORE if x == labels[0] else tb.SYNONYM_SCORE) for x in (*labels, *synonyms)]
        rows += [f"SELECT doc_id, page, '{name}' AS field, '{way}' AS way, unnest(regexp_extract_all(text, '{p}', 1)) AS value, {score} + {bonus} AS score, {longest} AS longest FROM dossiers" for p, way, score in every]
        score = f"{tb.CELL_SCORE} + CASE WHEN title <> '' THEN {tb.TITLED} ELSE 0 END"
        for x in (*labels, *synonyms):
            rows += [
                f"SELECT doc_id, page, '{name}', 'cell', trim(array_to_string(cells[2:], ' ')), {score}, {longest} FROM grid WHERE len(cells) >= 2 AND contains(lower(cells[1]), '{x.lower()}')",
                f"SELECT doc_id, page, '{name}', 'cell', regexp_extract(lower(array_to_string(cells, ' ')), '(?i){x}[^:]{{0,20}}[:\\s]+([^\\n]+)', 1), {score}, {longest} FROM grid WHERE len(cells) >= 2",
                f"SELECT doc_id, page, '{name}', 'column', coalesce(nullif(cells[p + 1], ''), nullif(cells[2], ''), ''), {tb.COLUMN_SCORE}, {longest} FROM (SELECT *, list_position(list_transform(columns, lambda x: contains(lower(x), '{x.lower()}')), true) AS p FROM grid) WHERE p > 0",
            ]
    return ", candidates AS (SELECT doc_id, page, field, way, substr(trim(regexp_replace(value, '\\s+', ' ', 'g')), 1, longest) AS value, score FROM (" + " UNION ALL ".join(rows) + "))"


WINNERS_SQL = WITH + GRID_SQL + _candidates_sql() + """, each AS (SELECT doc_id, field, value, min((-score, page, way)) AS b, count(DISTINCT way) AS n_ways FROM candidates WHERE length(value) >= 2 GROUP BY 1, 2, 3),
    best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY b, value) = 1), winners AS (SELECT doc_id, field, value, b[2] AS page, b[3] AS way, -b[1] AS score, n_ways FROM best)"""


@query("st29_field_candidates", WITH + GRID_SQL + _candidates_sql() + " SELECT field, way, score, count(*) AS n, count(DISTINCT doc_id) AS n_docs, md5(string_agg(DISTINCT value, '|' ORDER BY value)) AS said FROM candidates WHERE length(value) >= 2 GROUP BY 1, 2, 3")
def st29_candidates(spark, d):
    """How often each way gives each score, in how many documents, and a digest of the different values."""
    rows = tb.field_candidates(ds.dossiers(spark, d), FIELDS)
    return rows.groupBy("field", "way", "score").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.md5(F.array_join(F.array_sort(F.collect_set("value")), "|")).alias("said"))


@query("st29_winners", WINNERS_SQL + " SELECT * FROM winners")
def st29_winners(spark, d):
    return tb.field_winners(tb.field_candidates(ds.dossiers(spark, d), FIELDS))


@query("r11_field_confidence", WINNERS_SQL + """, e AS (SELECT *, CASE WHEN regexp_matches(value, '\\d') THEN 0.9 ELSE 0.5 END AS f, score / 16.0 AS c, CASE WHEN page <= 5 THEN 1.0 ELSE 0.5 END AS s, CASE WHEN score >= 14 THEN 0.15 ELSE 0.0 END AS h, CASE WHEN way IN ('cell', 'column') THEN 1.0 ELSE 0.0 END AS t, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.0 END AS v, CASE WHEN n_ways >= 3 THEN 1.0 ELSE n_ways * 0.4 END AS x FROM winners),
    z AS (SELECT *, f * 0.32 + least(1, c) * 0.22 + s * 0.12 + least(1, h / 0.15) * 0.08 + least(1, t) * 0.12 + least(1, v) * 0.1 + CASE WHEN x >= 1 THEN 0.06 WHEN x >= 0.7 THEN 0.04 ELSE 0.02 END + CASE WHEN f >= 0.88 AND c >= 0.4 AND t >= 0.5 THEN 0.03 ELSE 0 END + CASE WHEN v >= 0.85 AND f >= 0.8 THEN 0.02 ELSE 0 END AS total FROM e)
    SELECT doc_id, field, value, floor(least(0.97, greatest(0, total)) * 100 + 0.5)::DOUBLE / 100 AS confidence FROM z""".replace("0.32", "0.32::DOUBLE").replace("score / 16.0", "score / 16::DOUBLE"))
def r11(spark, d):
    """Winners with the confidence that their evidence gives: form, rank, early page, title, table, review and how many ways agree."""
    won = tb.field_winners(tb.field_candidates(ds.dossiers(spark, d), FIELDS))
    flag = lambda condition, yes, no=0.0: F.when(condition, yes).otherwise(no)
    confidence = tb.field_confidence(
        flag(c("value").rlike(r"\d"), 0.9, 0.5), c("score") / 16, flag(c("page") <= 5, 1.0, 0.5), flag(c("score") >= 14, 0.15), flag(c("way").isin("cell", "column"), 1.0), flag(c("doc_id") % 3 == 0, 0.9), F.when(c("n_ways") >= 3, 1.0).otherwise(c("n_ways") * 0.4))
    return won.select("doc_id", "field", "value", confidence.alias("confidence"))


# lines, headings and reasons on the same pages


COLON_SQL = tb.COLON_CELLS.replace("'", "''")


@query("st16_page_columns", WITH + f""", raw AS (SELECT doc_id, page, trim(unnest(string_split(text, chr(10)))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM dossiers),
    x AS (SELECT *, list_filter(list_transform(string_split_regex(said, '\\s{{2,}}'), lambda x: trim(x)), lambda x: x <> '') AS spaced FROM raw),
    y AS (SELECT doc_id, page, line, CASE WHEN contains(said, '|') THEN list_filter(list_transform(string_split(said, '|'), lambda x: trim(x)), lambda x: x <> '') WHEN contains(said, chr(9)) THEN list_filter(list_transform(string_split(said, chr(9)), lambda x: trim(x)), lambda x: x <> '')
      WHEN len(spaced) >= 2 THEN spaced WHEN regexp_extract(said, '{COLON_SQL}', 1) <> '' THEN [trim(regexp_extract(said, '{COLON_SQL}', 1)), trim(regexp_extract(said, '{COLON_SQL}', 2))] ELSE [said] END AS cells FROM x)
    SELECT doc_id, page, line, len(cells) AS n, coalesce(cells[1], '') AS first, md5(array_to_string(cells, '|')) AS digest FROM y""")
def st16_pages(spark, d):
    """The cells of every line, by pipes, tabs, wide gaps, a colon or a dash, or the whole line."""
    lines = ds.dossiers(spark, d).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "said")).select("doc_id", "page", (c("line") + 1).alias("line"), tb.cells(F.trim("said")).alias("cells"))
    return lines.select("doc_id", "page", "line", F.size("cells").cast("long").alias("n"), F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit("")).alias("first"), F.md5(F.array_join("cells", "|")).alias("digest"))


@query("st18_page_headings", WITH + r""", l AS (SELECT doc_id, page, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 4 AND 120), lambda x: regexp_matches(x, '(?i)^(?:section|chapter|part|schedule)\s+[\divxlc]+')
      OR regexp_matches(x, '^[A-Z][A-Z0-9\s\-–—:()]{6,}$') AND NOT regexp_matches(x, '(?i)shall|must|will') OR regexp_matches(x, '^(?:\d+\.?\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,6}$') AND length(x) < 80)[:15] AS h FROM dossiers)
    SELECT doc_id, page, len(h) AS n, array_to_string(h, '|') AS headings FROM l""")
def st18_pages(spark, d):
    return ds.dossiers(spark, d).select("doc_id", "page", tx.headings(c("text")).alias("h")).select("doc_id", "page", F.size("h").cast("long").alias("n"), F.array_join("h", "|").alias("headings"))


@query("st19_pair_reasons", WITH + PAIRS_SQL + f""", p AS (SELECT doc_id, page, place, name AS l, value AS v, {TIGHT_SQL.format('value')} FROM pairs)
    SELECT doc_id, page, place, {REASON_SQL} AS reason FROM p""")
def st19_pairs(spark, d):
    """Why a stated pair is of no business interest, by all rules in their order."""
    return pairs(spark, d).select("doc_id", "page", "place", F.coalesce(tx.irrelevance(c("name"), c("value")), F.lit("relevant")).alias("reason"))


# sections of pages by whole definitions


def _keyword_sql(keyword: str) -> str:
    if " " in keyword:
        return f"(length(low) - length(replace(low, '{keyword}', ''))) // {len(keyword)}"
    return f"len(regexp_extract_all(low, '\\b{keyword}\\b'))"


def _sections_sql() -> str:
    rows = []
    for name, keywords, patterns, titles in se.DEFINITIONS:
        words = " + ".join(f"{tx.keyword_weight(k)} * ({_keyword_sql(k)})" for k in keywords)
        marks = " + ".join([f"CASE WHEN regexp_matches(head, '(?i){p}') THEN {se.PATTERN} ELSE 0 END" for p in patterns] + [f"CASE WHEN regexp_matches(head, '(?i){t}') THEN {se.TITLE} ELSE 0 END" for t in titles])
        lines = " + ".join(f"{se.HEADING} * len(list_filter(h, lambda x: regexp_matches(x, '(?i){p}')))" for p in patterns)
        until, boost = se.EARLY.get(name, (0, 0))
        rows.append(f"SELECT doc_id, page, '{name}' AS section, {words} + {marks} + {lines} + CASE WHEN page <= {until} THEN {boost} ELSE 0 END AS score FROM heads")
    return " UNION ALL ".join(rows)


SECTIONS_SQL = WITH + r""", l AS (SELECT doc_id, page, text, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 4 AND 120), lambda x: regexp_matches(x, '(?i)^(?:section|chapter|part|schedule)\s+[\divxlc]+')
      OR regexp_matches(x, '^[A-Z][A-Z0-9\s\-–—:()]{6,}$') AND NOT regexp_matches(x, '(?i)shall|must|will') OR regexp_matches(x, '^(?:\d+\.?\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,6}$') AND length(x) < 80)[:15] AS h FROM dossiers),
    heads AS (SELECT doc_id, page, h, left(text, 5000) AS head, lower(left(text, 5000)) AS low FROM l), scored AS (""" + _sections_sql() + """),
    found AS (SELECT doc_id, page, section, score, least(99, greatest(35, floor(40 + score * 2.5 + 0.5)))::INT AS base FROM scored WHERE score >= 4),
    sections AS (SELECT doc_id, page, section, score::INT AS score, CASE WHEN section = 'Annexures' AND page <= 5 THEN greatest(35, base - 15) ELSE base END AS confidence FROM found
      UNION ALL SELECT doc_id, page, CASE WHEN page <= 5 THEN 'Identity' WHEN page <= 20 THEN 'Eligibility' ELSE 'Scope' END, 0, 45 FROM dossiers d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id AND f.page = d.page))"""


def page_sections(spark, d):
    """(doc_id, page, section, score, confidence) of every page, by the ten definitions; a page without any counts by its number."""
    scored = se.heads(ds.dossiers(spark, d)).select("doc_id", "page", *[se.section_score(*x).alias(f"s{k}") for k, x in enumerate(se.DEFINITIONS)])
    scores = [c(f"s{k}") for k in range(len(se.DEFINITIONS))]
    item = lambda name, score: F.struct(name.alias("section"), score.alias("score"))
    none = F.coalesce(F.greatest(*scores) < se.LEAST, F.lit(True))
    every = [F.when(s >= se.LEAST, item(F.lit(name), s)) for s, (name, *_) in zip(scores, se.DEFINITIONS)] + [F.when(none, item(se.fallback(c("page")), F.lit(0)))]
    kept = scored.select("doc_id", "page", F.array_compact(F.array(*every)).alias("s"))
    rows = kept.select("doc_id", "page", F.explode_outer("s").alias("x")).select("doc_id", "page", "x.*")
    return rows.withColumn("confidence", F.when(c("score") == 0, se.FALLBACK).otherwise(se.confidence_of(c("score"), c("section"), c("page"))))


@query("r03_dossier_sections", SECTIONS_SQL + " SELECT * FROM sections")
def r03_dossiers(spark, d):
    return page_sections(spark, d)


@query("a16_dossier_rollup", SECTIONS_SQL + " SELECT doc_id, section, floor(avg(confidence) + 0.5)::INT AS confidence, min(page) AS first, max(page) AS last, count(DISTINCT page) AS pages, max(score) AS best FROM sections GROUP BY 1, 2")
def a16_dossiers(spark, d):
    """Sections of a document: mean confidence, first and last page, number of pages, best score."""
    return page_sections(spark, d).groupBy("doc_id", "section").agg(
        F.floor(F.avg("confidence") + 0.5).cast("int").alias("confidence"), F.min("page").alias("first"), F.max("page").alias("last"), F.countDistinct("page").alias("pages"), F.max("score").alias("best"))
