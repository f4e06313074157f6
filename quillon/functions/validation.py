"""Strict validation of values by the kind of their parameter, and the verification of master rows.

A rule is a test on a value with the verdict it gives; the first test that holds decides. Tests are tuples: ``("re", pattern)``,
``("not", test)``, ``("all", tests...)``, ``("any", tests...)``, ``("chars", least, most)``, ``("words", least, most)``, ``("digits", least)``,
``("sentences", least)`` of over 40 characters, ``("upper",)``, ``("context", pattern)``, ``("first_number", least, most)``, ``("date",)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANY = 1 << 30
#: Patterns of kinds of text.
CURRENCY = r"(?i)(?:₹|rs\.?\b|inr\b|\blakh\b|\blac\b|\bcrore\b|\bcr\b)"
MONEY = r"(?i)(?:₹|rs\.?\b|inr\b|\blakh\b|\blac\b|\bcrore\b|\bcr\b|\$|€|£)?\s*[\d,]+(?:\.\d{1,2})?|\b[\d,]+(?:\.\d{1,2})?\s*(?:lakh|lac|crore|cr|thousand|k)\b"
OTHER_FIELD = r"(?i)\b(turnover|experience|years?\s+of\s+experience|similar\s+work|annual\s+turnover|past\s+experience|work\s+experience|minimum\s+experience|average\s+turnover)\b"
UNIT = r"(?i)\b(\d+\s*)?(days?|months?|years?|weeks?)\b"
CLAUSE, CLAUSE_LEADING = r"^\d+(?:\.\d+)+[\.\):]?\s*$", r"^\d+(?:\.\d+)+[\.\):]\s+"
HEADING = r"(?i)^(?:section|clause|annexure|schedule|particulars|note|chapter|part|item|sl\.?\s*no|sr\.?\s*no)\b"
PROSE = r"(?i)\b(shall|must|will\s+be|should\s+be|contractor\s+shall|bidder\s+shall|provided\s+that|notwithstanding|hereinafter|subject\s+to|in\s+accordance)\b"
NAVIGATION = r"(?i)\b(go\s+to|click\s+here|refer\s+annexure|see\s+annexure|table\s+of\s+contents|index\s+of)\b"
ANNEX = r"(?i)\b(?:annexure|appendix|enclosure|schedule)\s+[a-z0-9ivxlc]+\b"
SECTION_NAME = r"(?i)^(technical|financial|eligibility|compliance|identity|timeline|scope|experience|annexure|section\s+\d+|part\s+[ivxlc\d]+)$"
MONTH_NAME = r"(?i)^(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
GSTIN = r"(?i)[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
DATE = (
    r"(?i)\b(?:\d{1,2}[\s./-](?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s./-]\d{2,4}|\d{1,2}[\s./-]\d{1,2}[\s./-]\d{2,4}|\d{4}[\s./-]\d{1,2}[\s./-]\d{1,2}"
    r"|\d{1,2}:\d{2}\s*(?:am|pm)?\s+\w+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{2,4})"
)
NO_VALUE_CONTEXT = r"(?i)\b(turnover|experience|bank\s+solvency)\b"

EMPTY = ("chars", 0, 0)
IS_PROSE = (
    "any", EMPTY, ("chars", 201, MANY), ("re", PROSE), ("re", NAVIGATION), ("all", ("re", ANNEX), ("words", 0, 8)), ("sentences", 2),
    ("all", ("re", CLAUSE_LEADING), ("chars", 61, MANY)),
)
IS_HEADING = ("any", EMPTY, ("re", HEADING), ("re", SECTION_NAME), ("all", ("chars", 0, 80), ("upper",), ("re", r"[A-Z]{4,}")))

_AMOUNT = [
    (EMPTY, "REJECT", "financial_empty"), (IS_HEADING, "REJECT", "financial_heading"), (IS_PROSE, "REJECT", "financial_prose"),
    (("not", ("any", ("re", CURRENCY), ("re", MONEY))), "REJECT", "financial_missing_currency"), (("not", ("digits", 2)), "REJECT", "financial_invalid_amount"),
    (("re", OTHER_FIELD), "REJECT", "financial_wrong_field"), (None, "VALID", "strict_pass"),
]
_DURATION = [
    (EMPTY, "REJECT", "duration_empty"), (IS_HEADING, "REJECT", "duration_heading"), (IS_PROSE, "REJECT", "duration_prose"),
    (("any", ("re", r"^[\d.,()/\s-]{1,6}$"), ("re", r"^[\d.,()/-]+$"), ("re", r"^\d{1,2}\($")), "REJECT", "duration_broken_ocr"),
    (("all", ("re", UNIT), ("first_number", 1, 9999)), "VALID", "strict_pass"), (("re", r"^\d+\s*$"), "REVIEW", "duration_unit_review"), (None, "REJECT", "duration_invalid"),
]
#: The rules of each kind, in order.
RULES = {
    "emd": _AMOUNT, "financial_amount": _AMOUNT, "completion_period": _DURATION, "duration": _DURATION,
    "tender_value": [
        (EMPTY, "REJECT", "tender_value_empty"), (IS_HEADING, "REJECT", "tender_value_heading"), (IS_PROSE, "REJECT", "tender_value_prose"), (("re", OTHER_FIELD), "REJECT", "tender_value_turnover_experience"),
        (("any", ("context", NO_VALUE_CONTEXT), ("context", OTHER_FIELD)), "REJECT", "tender_value_wrong_context"), (("not", ("re", MONEY)), "REVIEW", "tender_value_currency_review"), (("not", ("digits", 2)), "REJECT", "tender_value_invalid_amount"), (None, "VALID", "strict_pass"),
    ],
    "bid_date": [
        (EMPTY, "REJECT", "bid_date_empty"), (IS_HEADING, "REJECT", "bid_date_heading"), (("re", CLAUSE), "REJECT", "bid_date_clause_number"),
        (("any", ("re", r"^\d{1,2}[\-/.(]$"), ("re", r"^[\d.,\s(/-]{1,5}$")), "REJECT", "bid_date_partial"), (("re", MONTH_NAME), "REJECT", "bid_date_month_only"),
        (("all", ("re", CLAUSE_LEADING), ("not", ("re", r"\d{1,2}[\s./-]\d{1,2}"))), "REJECT", "bid_date_clause_ref"), (("all", ("re", r"^[a-zA-Z\s,.\-/()&]+$"), ("not", ("re", r"\d"))), "REJECT", "bid_date_words_only"),
        (IS_PROSE, "REJECT", "bid_date_prose"), (("date",), "VALID", "strict_pass"), (("any", ("re", r"\d{1,2}[\s./-]\d{1,2}"), ("re", r"\d{4}")), "REVIEW", "bid_date_format_review"), (None, "REJECT", "bid_date_invalid"),
    ],
    "gst": [
        (EMPTY, "REJECT", "gst_empty"), (IS_PROSE, "REJECT", "gst_prose"), (("tight", GSTIN), "VALID", "strict_pass"),
        (("all", ("re", r"(?i)\bgst\b"), ("chars", 81, MANY)), "REJECT", "gst_narrative"), (None, "REJECT", "gst_invalid_format"),
    ],
    "pan": [(EMPTY, "REJECT", "pan_empty"), (IS_HEADING, "REJECT", "pan_heading"), (IS_PROSE, "REJECT", "pan_prose"), (("tight", r"[A-Z]{5}[0-9]{4}[A-Z]"), "VALID", "strict_pass"), (None, "REJECT", "pan_invalid_format")],
    "percentage": [
        (EMPTY, "REJECT", "percentage_empty"), (IS_PROSE, "REJECT", "percentage_prose"), (("any", ("all", ("re", "%"), ("re", r"\d")), ("re", r"(?i)\d+\s*(?:percent|pct)\b")), "VALID", "strict_pass"),
        (("re", r"\d+"), "REVIEW", "percentage_review"), (None, "REJECT", "percentage_invalid"),
    ],
    "experience": [
        (EMPTY, "REJECT", "experience_empty"), (("re", r"(?i)^(?:experience|similar\s+work|work\s+orders?|completion\s+certificates?|index|contents|table\s+of\s+contents)$"), "REJECT", "experience_heading"), (IS_HEADING, "REJECT", "experience_heading"),
        (("all", IS_PROSE, ("chars", 121, MANY)), "REJECT", "experience_toc"), (("all", ("re", r"(?i)\b(years?|works?|projects?|contracts?|completed|similar\s+work|work\s+orders?|certificates?)\b"), ("chars", 8, MANY)), "VALID", "strict_pass"),
        (("all", ("re", r"\d"), ("chars", 4, MANY)), "REVIEW", "experience_review"), (None, "REJECT", "experience_invalid"),
    ],
    "scope": [
        (EMPTY, "REJECT", "scope_empty"), (("re", r"(?i)^(?:scope|services|deliverables|activities|responsibilities|&\s*location|location|section\s+\d+(?:\.\d+)*)$"), "REJECT", "scope_heading"), (("re", SECTION_NAME), "REJECT", "scope_section_name"),
        (("re", r"(?i)^section\s+\d+"), "REJECT", "scope_clause"), (("re", NAVIGATION), "REJECT", "scope_navigation"), (("all", ("words", 0, 2), ("chars", 0, 19)), "REJECT", "scope_too_short"), (("re", r"(?i)^&\s*\w+$"), "REJECT", "scope_broken"),
        (("all", IS_PROSE, ("chars", 351, MANY)), "REVIEW", "scope_long_review"),
        (("all", ("chars", 12, MANY), ("re", r"(?i)\b(work|service|supply|deployment|maintenance|operation|provide|including|shall\s+include)\b")), "VALID", "strict_pass"),
        (("all", ("chars", 20, MANY), ("words", 4, MANY)), "VALID", "strict_pass"), (None, "REVIEW", "scope_review"),
    ],
}
#: The kind of a parameter by its label, the first that matches.
KINDS = [
    ("emd", r"\b(emd|earnest\s+money(\s+deposit)?|bid\s+security(\s+amount)?)\b"),
    ("tender_value", r"\b(tender\s+value|estimated\s+cost|project\s+cost|contract\s+value|estimated\s+tender\s+value|work\s+value)\b"),
    ("financial_amount", r"\b(tender\s+fee|document\s+fee|bid\s+fee|security\s+deposit|performance\s+security|performance\s+guarantee|bank\s+guarantee|pbg|ebg)\b"),
    ("bid_date", r"\b(bid\s+(start|end|opening|closing|submission)\s*date|last\s+date|submission\s+deadline|pre[\s-]?bid|technical\s+(?:opening|bid)|financial\s+(?:opening|bid)|publishing\s+date|nit\s+date)\b"),
    ("completion_period", r"\b(completion\s+period|contract\s+period|time\s+for\s+completion|duration\s+of\s+work)\b"),
    ("duration", r"\b(bid\s+validity|warranty\s+period|amc\s+duration|defect\s+liability)\b"),
    ("gst", r"\bgst\b|\bgstin\b"), ("pan", r"\bpan\b|\bpermanent\s+account\s+number\b"),
    ("percentage", r"\b(emd\s+percentage|pbg\s+percentage|performance\s+security\s+percentage|experience\s+percentage)\b"),
    ("experience", r"\b(experience\s+requirement|similar\s+work|work\s+completion|past\s+project|client\s+reference)\b"),
    ("scope", r"\b(scope\s+of\s+work|services|deliverables|deployment|activities|responsibilities)\b"),
]


def kind_of(label: Column) -> Column:
    """The kind of a parameter; null for those without strict rules."""
    low = F.lower(label)
    return F.coalesce(*[F.when(low.rlike(p), k) for k, p in KINDS])


def is_date(v: Column) -> Column:
    """A date of up to 120 characters whose year, day and month are possible."""
    year = F.regexp_extract(v, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    parts = [F.regexp_extract(v, r"\b(\d{1,2})[\s./-](\d{1,2})[\s./-](\d{2,4})\b", g).try_cast("int") for g in (1, 2)]
    possible = F.coalesce(parts[0].between(1, 31) & parts[1].between(1, 12), F.lit(True))
    return F.char_length(v).between(1, 120) & v.rlike(DATE) & F.coalesce(year >= 1990, F.lit(True)) & possible


def holds(test: tuple | None, v: Column, context: Column) -> Column:
    """Whether a test holds for a trimmed value."""
    if test is None:
        return F.lit(True)
    name, *args = test
    if name in ("all", "any"):
        out = holds(args[0], v, context)
        for t in args[1:]:
            out = out & holds(t, v, context) if name == "all" else out | holds(t, v, context)
        return out
    simple = {
        "not": lambda: ~holds(args[0], v, context), "re": lambda: v.rlike(args[0]), "context": lambda: context.rlike(args[0]), "tight": lambda: F.regexp_replace(v, r"\s", "").rlike(args[0]),
        "chars": lambda: F.char_length(v).between(*args), "words": lambda: F.size(F.split(v, r"\s+")).between(*args), "digits": lambda: F.char_length(F.regexp_replace(v, r"[^\d]", "")) >= args[0],
        "sentences": lambda: F.size(F.filter(F.split(v, "[.!?]"), lambda s: F.char_length(F.trim(s)) > 40)) >= args[0], "upper": lambda: v == F.upper(v),
        "first_number": lambda: F.coalesce(F.regexp_extract(v, r"\d+", 0).try_cast("decimal(38,0)").between(*args), F.lit(False)), "date": lambda: is_date(v),
    }
    return simple[name]()


def strict_verdict(kind: Column, value: Column, context: Column) -> Column:
    """struct<status, rule> of a value: VALID, REVIEW or REJECT and the rule that says so; null for a kind without rules. Null values are empty."""
    v, near = F.trim(F.coalesce(value, F.lit(""))), F.coalesce(context, F.lit(""))
    out = None
    for name, rules in RULES.items():
        verdict = None
        for test, status, rule in rules:
            said = F.struct(F.lit(status).alias("status"), F.lit(rule).alias("rule"))
            verdict = F.when(holds(test, v, near), said) if verdict is None else verdict.when(holds(test, v, near), said) if test else verdict.otherwise(said)
        out = F.when(kind == name, verdict) if out is None else out.when(kind == name, verdict)
    return out


# verification of master rows


#: Weights of a row's evidence, and the scores from which it counts as verified.
WEIGHTS = {"validation": 30, "page": 20, "section": 20, "type": 10, "alias": 10, "review": 10}
AUTO, VERIFIED, REVIEW = 90, 70, 50
SECTION_NOISE = r"(?i)\b(table\s+of\s+contents|index|annexure|appendix|navigation|header|footer)\b"


def verification_scores(validation: Column, page: Column, low_section: Column, section: Column, label: Column, type_match: Column, method: Column, mapped: Column, score: Column, renamed: Column) -> Column:
    """struct of the scores of a row's validation, page, section, tender type and alias, and their total without the review's."""
    low, sec = F.lower(label), F.lower(F.trim(F.coalesce(section, F.lit(""))))
    has = lambda *words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), True) for w in words], F.lit(False))
    fits = (has("emd", "tender value", "bid") & sec.rlike(r"\b(financial|nit|summary|identity|timeline)\b")) | (has("scope") & sec.rlike(r"\b(scope|technical|services)\b")) | (has("experience") & sec.rlike(r"\b(eligibility|experience|qualification)\b"))
    parts = {
        "validation": F.when(validation == "REJECT", 0).when(validation.isin("VALID", "VALID_DYNAMIC_PARAMETER"), 30).when(validation == "REVIEW", 15).otherwise(10),
        "page": F.when(low_section, 0).when(page <= 5, 20).when(page <= 20, 15).when(page <= 50, 10).otherwise(5),
        "section": F.when(sec.isin("", "general"), 5).when(sec.rlike(SECTION_NOISE), 0).when(fits, 20).when(F.char_length(sec) > 3, 10).otherwise(5),
        "type": F.when(type_match, 10).otherwise(0),
        "alias": F.when(method.isin("exact_canonical", "exact_alias") | (mapped & (score >= 80)), 10).when(mapped, 5).when(renamed, 8).otherwise(3),
    }
    total = sum(parts.values(), F.lit(0))
    return F.struct(*[c.cast("int").alias(n) for n, c in parts.items()], total.cast("int").alias("total"))


def verification_status(total: Column, review: Column, confidence: Column, rejected: Column) -> Column:
    """struct<status, confidence> of a row by its score, the review's status and confidence, and whether strict validation rejects it."""
    combined = total + F.when(review == "VERIFIED", 10).when(review == "REVIEW", 5).otherwise(0)
    said = lambda status, c: F.struct(F.lit(status).alias("status"), c.cast("int").alias("confidence"))
    most = F.greatest(confidence, combined)
    return (
        F.when(rejected | (review == "REJECT"), said("REJECT", F.least(confidence, F.lit(30)))).when((review == "VERIFIED") & (combined >= VERIFIED), said("VERIFIED", most))
        .when(total >= AUTO, said("VERIFIED", F.greatest(F.lit(92), combined))).when((review == "VERIFIED") | (combined >= VERIFIED), said("VERIFIED", most))
        .when((review == "REVIEW") | (combined >= REVIEW), said("REVIEW", most)).otherwise(said("REJECT", F.least(confidence, combined)))
    )


# contexts of candidates


#: Sections by what their context says, with their priority.
SECTIONS = [
    ("Notice Inviting Tender", 100, r"\b(notice\s+inviting\s+tender|invitation\s+for\s+bid|nit|tender\s+notice)\b"), ("Tender Summary", 90, r"\b(tender\s+summary|key\s+details|salient\s+features|at\s+a\s+glance|brief\s+summary)\b"),
    ("Important Dates", 85, r"\b(important\s+dates?|bid\s+schedule|tender\s+schedule|schedule\s+of\s+bid)\b"), ("Eligibility Criteria", 80, r"\b(eligibility\s+criteria|qualification\s+criteria|pre\s*qualification)\b"),
    ("Financial Conditions", 80, r"\b(financial\s+conditions?|financial\s+bid|price\s+bid|commercial\s+bid)\b"), ("Scope Of Work", 75, r"\b(scope\s+of\s+work|technical\s+specifications?|statement\s+of\s+work)\b"),
    ("Tender Particulars", 70, r"\b(particulars|tender\s+details|tender\s+particulars)\b"),
]
LOW_SECTION = r"\b(annexure|appendix|declaration\s+form|integrity\s+pact|checklist|table\s+of\s+contents|index\s+of|header|footer|page\s+number)\b"
#: Contexts that a field's candidate must not stand in unless another one is there too, and the reason.
CONTEXT_RULES = {
    "tender_value": (r"\b(turnover|experience|similar\s+work|bank\s*solvency|solvency\s+certificate)\b", r"\b(tender\s*value|estimated\s*cost|project\s*cost|contract\s*value|work\s*value|estimated\s*tender\s*value|value\s*of\s*work)\b", "wrong_context_not_tender_value"),
    "emd": (r"\b(performance\s*(guarantee|security|bond)|pbg|performance\s+bank\s+guarantee)\b", r"\b(emd|earnest\s*money|bid\s*security)\b", "wrong_context_not_emd"),
    "bid_date": (r"\b(pre[\s-]?bid|opening\s+date|technical\s+opening|financial\s+opening|contract\s+(date|period)|publishing\s+date)\b", r"\b(bid\s*end|last\s+date\s+of\s+submission|submission\s+deadline|closing\s+date|bid\s+closing)\b", "wrong_context_not_bid_end_date"),
}
#: Weights of the factors of a candidate's score.
FACTORS = {"label": 0.22, "context": 0.18, "section": 0.15, "page": 0.25, "table": 0.08, "scan": 0.05, "model": 0.07}
TABLE_WORDS, TABLE_SHAPE = r"(?i)\b(sl\.?\s*no|sr\.?\s*no|particulars|description|amount|details)\b[^\n]*\b(date|value|fee|emd|turnover)\b", r"(\|\s*\w+)|(\t\w+)|(\s{3,}\w+\s{3,})"
GARBAGE = r"(?i)[|]{3,}|_{3,}|x{4,}"


def section_priority(context: Column) -> Column:
    """struct<score, section>: the best section that a context names, 40 for none, 20 for what else than content it names."""
    low = F.lower(context)
    named = F.coalesce(*[F.when(low.rlike(p), F.struct(F.lit(s).alias("score"), F.lit(n).alias("section"))) for n, s, p in SECTIONS], F.struct(F.lit(40).alias("score"), F.lit("general").alias("section")))
    return F.when(low.rlike(LOW_SECTION), F.struct(F.lit(20).alias("score"), F.lit("low_priority_section").alias("section"))).otherwise(named)


def context_violation(kind: Column, text: Column) -> Column:
    """Why a candidate of a kind may not stand in its context; null where it may."""
    low = F.lower(text)
    return F.coalesce(*[F.when((kind == k) & low.rlike(bad) & ~low.rlike(good), reason) for k, (bad, good, reason) in CONTEXT_RULES.items()])


def table_score(context: Column, source: Column) -> Column:
    both = F.concat(context, F.lit("\n"), source)
    return F.when(both.rlike(TABLE_WORDS), 100).when(source.rlike(TABLE_SHAPE), 85).when(both.rlike(r"(?i)\bschedule\b") & both.rlike(r"(?i)\bdate\b"), 75).otherwise(20)


def scan_score(source: Column, value: Column) -> Column:
    """How clean a candidate's text is."""
    text = F.trim(F.concat(source, F.lit(" "), value))
    share = F.char_length(F.regexp_replace(text, "[^a-zA-Z0-9]", "")) / F.char_length(text)
    torn = text.rlike(r"[a-zA-Z]{1,2}\s[a-zA-Z]{1,2}\s[a-zA-Z]{1,2}") & (F.char_length(text) < 40)
    return F.when(F.char_length(text) < 6, 20).when(text.rlike(GARBAGE), 25).when(torn, 40).when(share >= 0.5, 95).when(share >= 0.35, 75).otherwise(50)


def weighted_score(**factors: Column) -> Column:
    """The weighted sum of a candidate's factors, rounded, at most 100."""
    return F.least(F.lit(100), F.floor(sum((factors[n] * w for n, w in FACTORS.items()), F.lit(0.0)) + 0.5)).cast("int")
