"""Rule scoring: weighted keywords, additive ranks, confidence bands, validators, eligibility, risk and recommendations.

Every rule works on one row, so scoring needs no shuffle and stays in generated code. Keyword tables are
parameters: (name, keywords[, patterns]) in an order that decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.money import parse_amount
from quillon.functions.text import hits_in, keyword_weight

#: Service categories with their keywords, in the order that decides ties.
SERVICES = (
    ("Security Services", ("security guard", "armed guard", "unarmed guard", "watch and ward", "psara", "cctv", "access control", "security services", "security agency", "patrolling", "surveillance")),
    ("Manpower Services", ("manpower", "labour supply", "contract labour", "skilled labour", "unskilled labour", "driver", "operator", "helper", "technician", "workforce deployment")),
    ("Housekeeping Services", ("housekeeping", "cleaning", "sanitation", "janitorial", "waste management", "deep cleaning")),
    ("Facility Management", ("facility management", "building maintenance", "operations and maintenance", "o&m", "estate management", "integrated facility", "fm services")),
    ("Horticulture", ("horticulture", "landscaping", "gardening", "lawn maintenance", "green belt", "nursery")),
    ("Civil Works", ("civil works", "construction", "building work", "structural work", "road work", "cpwd")),
    ("Electrical Works", ("electrical works", "wiring", "substation", "transformer", "lt panel", "electrical installation")),
    ("Mechanical Works", ("mechanical works", "fabrication", "erection", "piping", "mechanical installation", "hvac")),
    ("IT Services", ("it services", "software", "hardware", "network", "cloud", "erp", "data center", "system integration")),
    ("Supply Tenders", ("supply of", "procurement of", "purchase of", "rate contract", "goods supply", "material supply")),
    ("Consultancy", ("consultancy", "consulting", "advisory", "feasibility study", "project management consultant")),
    ("Healthcare", ("hospital", "medical", "healthcare", "diagnostic", "pharmacy", "biomedical")),
    ("Education", ("school", "college", "education", "training", "academic", "e-learning")),
    ("Transportation", ("transport", "vehicle hire", "logistics", "fleet", "bus service", "railways")),
    ("Mixed Services", ("composite bid", "multiple services", "combined tender", "integrated services", "turnkey")),
)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hits(normal: Column, keyword: str) -> Column:
    """Occurrences of a keyword in a text in lower case with single spaces: phrases as they stand, words as whole words."""
    return hits_in(normal, keyword)


def classified(rows: DataFrame, text: str, rules, base: int, step: int, cap: int, floor: int, per_pattern: int = 3) -> DataFrame:
    """Rows with the best of several keyword rules for a text: struct ``k`` <name, confidence, score, second, matched>, '' and 0 where none scores.

    The score sums hits by keyword weight, and ``per_pattern`` for each pattern found. Confidence is ``base`` plus
    ``step`` times the lead over the second plus the score up to ``cap``, between ``floor`` and 99. The first rule wins ties.
    The normal form of the text and the scores are columns of their own, so each is worked out once a row.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    normal = F.col("_normal")
    scores = []
    for name, keywords, *patterns in rules:
        score = sum((hits(normal, w) * keyword_weight(w) for w in keywords), F.lit(0))
        score = score + sum((F.when(said.rlike(p), per_pattern).otherwise(0) for p in (patterns[0] if patterns else ())), F.lit(0))
        scores.append(score.cast("int"))
    made = rows.withColumn("_normal", F.trim(F.regexp_replace(F.lower(said), r"\s+", " ")))
    made = made.select("*", *[s.alias(f"_s{k}") for k, s in enumerate(scores)])
    order = F.array_sort(F.array(*[F.struct((-F.col(f"_s{k}")).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name"), F.array(*map(F.lit, keywords)).alias("keywords")) for k, (name, keywords, *_) in enumerate(rules)]))
    made = made.withColumn("_o", order)
    one, two = F.col("_o")[0], F.col("_o")[1]
    whole = lambda w: F.rlike(normal, F.concat(F.lit(r"(?<!\w)\Q"), w, F.lit(r"\E(?!\w)")))
    matched = F.filter(one["keywords"], lambda w: F.contains(normal, w) & (F.contains(w, F.lit(" ")) | whole(w)))
    best = F.struct(
        F.when(one["s"] < 0, one["name"]).otherwise("").alias("name"),
        F.when(one["s"] < 0, F.least(F.lit(99), F.greatest(F.lit(floor), base + step * (two["s"] - one["s"]) + F.least(-one["s"], F.lit(cap))))).otherwise(0).cast("int").alias("confidence"),
        (-one["s"]).alias("score"), (-two["s"]).alias("second"), F.when(one["s"] < 0, matched).otherwise(F.array().cast("array<string>")).alias("matched"))
    return made.select(*rows.columns, best.alias("k"))


def service_class(rows: DataFrame, text: str) -> DataFrame:
    return classified(rows, text, SERVICES, 55, 4, 20, 40)


def profile_class(rows: DataFrame, text: str, profiles) -> DataFrame:
    """As ``service_class`` for profiles with heading patterns (name, keywords, patterns)."""
    return classified(rows, text, profiles, 50, 3, 25, 35)


# ranks of candidates -----------------------------------------------------------------------------------------------


def page_priority(page: Column, low_section: Column) -> Column:
    """100, 70 or 40 by page; 10 in sections of low priority."""
    return F.when(low_section, 10).when(page <= 5, 100).when(page <= 20, 70).otherwise(40)


#: Labels of which summary pages are the best source.
CORE_LABEL = (
    r"(?i)\b(tender\s+(?:no|number|value)|nit|organization|department|emd|earnest|document\s+fee|tender\s+fee|bid\s+(?:end|start|opening)|completion\s+period|contract\s+period|scope\s+of\s+work|estimated\s+cost)\b"
)


def candidate_page_priority(page: Column, parameter: Column, low_section: Column) -> Column:
    """Page priority with 10 more for core parameters on the first pages, and 30 less for them elsewhere."""
    base = page_priority(page, low_section)
    early = (page <= 5) & ~low_section
    return F.when(~F.coalesce(parameter, F.lit("")).rlike(CORE_LABEL), base).when(early, F.least(F.lit(100), base + 10)).otherwise(F.greatest(F.lit(10), base - 30))


def additive_rank(page: Column, low_section: Column, section: Column, alias_mapped: Column, alias_score: Column, same_label: Column, type_match: Column, validation: Column, source: Column, confidence: Column) -> Column:
    """struct of the seven parts of a candidate's rank and their total."""
    parts = {
        "page_score": F.when(low_section, 0).when(page <= 5, 30).when(page <= 20, 20).otherwise(10),
        "section_score": F.when(section == "primary", 25).when(section == "fallback", 10).otherwise(0),
        "alias_score": F.when(same_label & ~alias_mapped, 20).when(alias_mapped & (F.coalesce(alias_score, F.lit(0)) >= 80), 15).when(alias_mapped, 5).otherwise(5),
        "type_score": F.when(type_match, 15).otherwise(0),
        "validation_score": F.when(validation.isin("VALID", "VALID_DYNAMIC_PARAMETER"), 30).when(validation == "REVIEW", 10).otherwise(0),
        "source_score": F.when(source == "AI+RULE", 25).when(source == "RULE", 15).otherwise(10),
        "verification_score": F.least(F.lit(10), rounded(F.coalesce(confidence, F.lit(0)) / 10)),
    }
    total = sum(parts.values(), F.lit(0))
    return F.struct(*[c.cast("int").alias(n) for n, c in parts.items()], total.cast("int").alias("total"))


def validation_confidence(priority: Column, section: Column, alias_mapped: Column, alias_score: Column, format_status: Column, type_match: Column) -> Column:
    """At most 100: page 30 or 15, section 25 or 12, alias 15 or 8, format 20 or 8, type 20."""
    parts = [
        F.when(priority >= 70, 30).when(priority >= 40, 15).otherwise(0),
        F.when(section == "primary", 25).when(section == "fallback", 12).otherwise(0),
        F.when(alias_mapped & (F.coalesce(alias_score, F.lit(0)) >= 80), 15).when(alias_mapped, 8).otherwise(0),
        F.when(format_status.isin("VALID", "PASS"), 20).when(format_status == "REVIEW", 8).otherwise(0),
        F.when(type_match, 20).otherwise(0),
    ]
    return F.least(F.lit(100), sum(parts, F.lit(0))).cast("int")


def layered_status(statuses: list[Column], rank: Column, confidence: Column, repeats: Column) -> Column:
    """struct<status, confidence>: the worst status of several layers.

    Repeats of a value on other pages, from two on, lift the confidence by half of up to 15; so does a tenth of the
    rank. A rejected candidate keeps two fifths.
    """
    worst = F.lit("VALID")
    for s in statuses:
        worst = F.when((worst == "REJECT") | (s == "REJECT"), "REJECT").when((worst == "REVIEW") | (s == "REVIEW"), "REVIEW").otherwise("VALID")
    boost = F.when(repeats >= 2, F.least(F.lit(15), 5 * repeats)).otherwise(0)
    kept = F.least(F.lit(100), rounded(confidence + 0.5 * boost + 0.1 * rank))
    return F.struct(worst.alias("status"), F.when(worst == "REJECT", rounded(kept * 0.4)).otherwise(kept).cast("int").alias("confidence"))


def band_confidence(method: Column, valid: Column, ai_confidence: Column, correctness: Column, value: Column, page: Column) -> Column:
    """struct<band, confidence>: bands by method, validation and verification, then adjustments.

    ``valid`` is null where nothing was validated. A verified value has a confidence of 70 or more, a text, and is not incorrect.
    """
    low, high = (lambda x, a, b: between(rounded(x), a, b)), F.coalesce(ai_confidence, F.lit(70))
    verified = F.coalesce((correctness != "incorrect") & (F.coalesce(ai_confidence, F.lit(0)) >= 70) & (F.trim(value) != ""), F.lit(False))
    ok = F.coalesce(valid, F.lit(False))
    lift = lambda width: (high - 70) / 30 * width
    is_ = lambda name: method == name
    cases = [
        (valid.isNotNull() & ~ok, "invalid", low(15 + F.coalesce(ai_confidence, F.lit(0)) * 0.15, 0, 35)),
        (is_("ai_inferred"), "inferred", low(60 + (F.coalesce(ai_confidence, F.lit(55)) - 50) / 50 * 15, 60, 75)),
        (is_("exact") & ok & verified, "exact verified", low(95 + lift(5), 95, 100)),
        (is_("regex") & ok & verified, "regex verified", low(90 + lift(5), 90, 95)),
        (is_("alias") & ok & verified, "alias verified", low(85 + lift(5), 85, 90)),
        (is_("fuzzy") & ok & verified, "fuzzy verified", low(80 + lift(5), 75, 85)),
        (is_("fuzzy") & ok, "fuzzy validated", F.lit(78)),
        (is_("exact") & ok, "exact validated", F.lit(90)),
        (is_("regex") & ok, "regex validated", F.lit(85)),
        (is_("alias") & ok, "alias validated", F.lit(81)),
        (is_("fuzzy"), "fuzzy", F.lit(68)),
        (ok & verified, "validated verified", low(80 + lift(8), 80, 88)),
        (ok, "validated", F.lit(74)),
    ]
    band, score = F.lit("unvalidated"), F.lit(50)
    for condition, name, points in reversed(cases):
        condition = F.coalesce(condition, F.lit(False))
        band, score = F.when(condition, name).otherwise(band), F.when(condition, points).otherwise(score)
    score = F.when(page.between(1, 3) & (score < 100), between(score + 2, 0, 100)).otherwise(score)
    score = F.when((correctness == "uncertain") & (score > 70), score - 8).otherwise(score)
    score = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", 0).otherwise(score)
    return F.struct(band.alias("band"), score.cast("int").alias("confidence"))


# validators --------------------------------------------------------------------------------------------------------


def _checked(value: Column, reason: Column) -> Column:
    return F.struct(value.isNotNull().alias("valid"), value.alias("value"), F.when(value.isNull(), reason).alias("reason"))


def valid_currency(raw: Column) -> Column:
    """struct<valid, value, reason>: whole rupees as text; words for nothing are 0."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    amount = parse_amount(t)
    value = F.when(t.rlike(r"(?i)^(?:nil|na|n/a|not applicable|exempt(?:ed)?)$"), "0").when(amount > 0, rounded(amount).cast("long").cast("string"))
    return _checked(value, F.when(t == "", "empty").otherwise("not_an_amount"))


def valid_email(raw: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    return _checked(F.when(t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), F.lower(t)), F.when(t == "", "empty").otherwise("not_an_address"))


def valid_phone(raw: Column) -> Column:
    """The last ten digits, which begin with 6 to 9."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    digits = F.regexp_replace(t, r"\D", "")
    ten = F.substring(digits, -10, 10)
    return _checked(F.when(ten.rlike(r"^[6-9]\d{9}$"), ten), F.when(t == "", "empty").when(F.char_length(ten) != 10, "not_ten_digits").otherwise("not_a_mobile_number"))


def valid_tender_number(raw: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    found = F.regexp_extract(t, r"([A-Za-z0-9][A-Za-z0-9/\-_.]{4,50})", 1)
    mixed = found.rlike("[A-Za-z]") & found.rlike(r"\d")
    return _checked(F.when(mixed, found), F.when(t == "", "empty").when(found == "", "no_number").otherwise("letters_and_digits"))


def valid_master_value(key: Column, value: Column, numbers_reject: tuple[str, ...] = (), names_reject: tuple[str, ...] = ()) -> Column:
    """Reason why a master field's value is not valid, or null."""
    v, low = F.trim(F.coalesce(value, F.lit(""))), F.lower(F.coalesce(value, F.lit("")))
    is_number, is_name = key.isin("tenderNumber", "nitNumber", "bidReferenceNumber"), key.isin("organization", "department")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    return (
        F.when(v == "", "empty").when(is_number & has(numbers_reject), "rejected_phrase").when(is_number & (F.char_length(v) > 150), "too_long")
        .when(is_number & (F.size(F.split(v, r"\s+")) > 20), "too_many_words").when(is_name & has(names_reject), "rejected_phrase")
        .when(is_name & (F.char_length(v) > 150), "too_long").when(F.char_length(v) > 500, "too_long")
    )


# eligibility -------------------------------------------------------------------------------------------------------

#: Weights of the nine checks, in order: turnover, experience, maker's authority, deposit, small enterprise, GST, PAN, ISO, technical.
CHECKS = ("turnover", "experience", "oem", "deposit", "msme", "gst", "pan", "iso", "technical")
WEIGHTS_A, WEIGHTS_B = (15, 15, 10, 10, 10, 10, 5, 10, 15), (15, 15, 10, 12, 8, 10, 8, 12, 10)


def eligibility(passed: list[Column], weights: tuple[int, ...], strict_all: bool) -> Column:
    """struct<status, score, n_passed, failed> of weighted checks.

    ``strict_all``: eligible if all pass, partially from 60 % of the checks on. Otherwise eligible from a score of 80 with
    at most one failure, partially from 50.
    """
    n = sum((p.cast("int") for p in passed), F.lit(0))
    score = rounded(sum((F.when(p, w).otherwise(0) for p, w in zip(passed, weights)), F.lit(0)) * 100 / sum(weights))
    if strict_all:
        status = F.when(n == len(passed), "ELIGIBLE").when(n >= 0.6 * len(passed), "PARTIALLY_ELIGIBLE").otherwise("NOT_ELIGIBLE")
    else:
        status = F.when((score >= 80) & (n >= len(passed) - 1), "ELIGIBLE").when(score >= 50, "PARTIALLY_ELIGIBLE").otherwise("NOT_ELIGIBLE")
    failed = F.array_compact(F.array(*[F.when(~p, name) for p, name in zip(passed, CHECKS)]))
    return F.struct(status.alias("status"), score.cast("int").alias("score"), n.alias("n_passed"), failed.alias("failed"))


def adjusted_eligibility(score: Column, n_documents: Column, deposit: Column, value: Column) -> Column:
    """The score less a point for each required document up to 7.5, and 5 for a deposit above a twentieth of the value."""
    score = F.when(n_documents > 0, F.greatest(F.lit(0.0), score - F.least(n_documents * 2, F.lit(15)) / 2)).otherwise(score.cast("double"))
    score = score - F.when((deposit > 0) & (value > 0) & (deposit / value > 0.05), 5).otherwise(0)
    return between(rounded(score), 0, 100).cast("int")


# risk and recommendation -------------------------------------------------------------------------------------------

LEVELS = ("LOW", "MEDIUM", "HIGH")


def worst_level(levels: list[Column]) -> Column:
    any_of = lambda level: F.array_contains(F.array(*levels), level)
    return F.when(any_of("HIGH"), "HIGH").when(any_of("MEDIUM"), "MEDIUM").otherwise("LOW")


def by_missing(missing: list[Column]) -> Column:
    """HIGH from two missing on, MEDIUM at one."""
    n = sum((m.cast("int") for m in missing), F.lit(0))
    return F.when(n >= 2, "HIGH").when(n == 1, "MEDIUM").otherwise("LOW")


def financial_risk(deposit: Column, value: Column, security: Column, penalties: Column, turnover: float) -> Column:
    """Of raw texts, '' or null where not found."""
    lost = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    level = by_missing([lost(deposit), lost(value), lost(security)])
    level = F.when((level == "LOW") & F.coalesce(penalties, F.lit("")).rlike(r"(?i)liquidated|penalty|forfeit|ld\s"), "MEDIUM").otherwise(level)
    return F.when(F.coalesce(parse_amount(deposit), F.lit(0.0)) > 0.05 * turnover, "HIGH").otherwise(level)


def timeline_risk(days_left: Column, has_deadline: Column, has_period: Column, period: Column) -> Column:
    level = by_missing([~has_deadline, ~has_period])
    near, soon = days_left.between(0, 7), days_left.between(8, 14)
    level = F.when(F.coalesce(near, F.lit(False)), "HIGH").when(F.coalesce(soon, F.lit(False)) & (level != "HIGH"), "MEDIUM").otherwise(level)
    return F.when((level == "LOW") & F.coalesce(period, F.lit("")).rlike(r"(?i)short\s+period|tight|immediate|urgent|days?\s+only"), "MEDIUM").otherwise(level)


def technical_risk(scope: Column, equipment: Column, manpower: Column) -> Column:
    found = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    hard = F.coalesce(scope, F.lit("")).rlike(r"(?i)cctv|surveillance|integration|oem|iso\s*9001|custom\s+development|turnkey|multi\s*site")
    return F.when(~found(scope), "HIGH").when(hard | ~(found(equipment) | found(manpower)), "MEDIUM").otherwise("LOW")


def compliance_risk(certificates: Column, security: Column, has_iso: bool, has_gst: bool) -> Column:
    c = F.lower(F.trim(F.coalesce(certificates, F.lit(""))))
    lost = [c == "", F.trim(F.coalesce(security, F.lit(""))) == ""]
    must = [F.lit(not has_iso) & c.rlike(r"iso\s*9001|iso\s+cert"), F.lit(not has_gst) & c.rlike("gst|goods and services tax")]
    n = sum((x.cast("int") for x in [*lost, *must]), F.lit(0))
    many = F.size(F.filter(F.split(c, r"[,;|•\n]+"), lambda x: x != "")) > 8
    return F.when((n >= 2) | must[0] | must[1], "HIGH").when(n == 1, "MEDIUM").when(many, "MEDIUM").otherwise("LOW")


def eligibility_risk(required_turnover: Column, required_years: Column, found: Column, turnover: float, years: int) -> Column:
    beyond = (F.coalesce(required_turnover, F.lit(0.0)) > turnover) | (F.coalesce(required_years, F.lit(0)) > years)
    return F.when(beyond | ~found, "HIGH").otherwise("LOW")


def data_quality(total: Column, populated: Column, mean_confidence: Column, low: Column) -> Column:
    """0 to 100 from the share of fields that are filled, their mean confidence, and a penalty for doubtful ones."""
    ratio = F.when(total > 0, populated / total).otherwise(0.0)
    penalty = F.least(F.lit(0.3), low / F.greatest(total, F.lit(1)) * 0.5)
    return rounded(between((ratio * 0.45 + mean_confidence / 100 * 0.55 - penalty) * 100, 0, 100)).cast("int")


def recommendation(critical: Column, concerns: Column, quality: Column, overall: Column, eligibility_level: Column, financial: Column, timeline: Column, n_high: Column, n_medium: Column) -> Column:
    high = lambda c: c == "HIGH"
    stop = (critical >= 2) | ((critical >= 1) & high(eligibility_level)) | (high(eligibility_level) & high(financial)) | (high(overall) & high(eligibility_level))
    look = (quality < 55) | (critical >= 1) | (n_high >= 2) | (high(overall) & high(timeline)) | (concerns >= 4)
    careful = (overall == "MEDIUM") | (n_medium >= 2) | (concerns >= 2) | (quality < 75)
    return F.when(stop, "Do Not Apply").when(look, "Need Manual Review").when(careful, "Apply With Caution").otherwise("Apply Immediately")


def feasibility(readiness: Column, overall: Column, critical_missing: Column, n_high: Column) -> Column:
    """``overall`` is Low, Medium or High."""
    return (
        F.when((readiness >= 90) & (overall == "Low") & (critical_missing == 0), "Strongly Recommended").when((readiness >= 75) & (overall != "High"), "Recommended")
        .when((readiness >= 55) | (critical_missing <= 2), "Recommended With Conditions").when((n_high >= 2) | (critical_missing >= 3), "High Risk").otherwise("Not Recommended")
    )


# checklists --------------------------------------------------------------------------------------------------------


def item_status(required: Column, uploaded: Column, expired: Column, review: Column, marked: Column) -> Column:
    return (
        F.when(review == "approved", "approved").when(review == "rejected", "rejected").when(~required, "optional").when(~uploaded & ~marked, "missing")
        .when(expired, "expired").when(uploaded & (F.coalesce(review, F.lit("")) == "pending"), "pending_review").otherwise("uploaded")
    )


def display_status(required: Column, status: Column, uploaded: Column) -> Column:
    return F.when(status == "approved", "verified").when((status == "uploaded") | uploaded, "uploaded").when(~required, "optional").when(status == "missing", "missing").otherwise("required")


# sections, contexts and filters of candidates ------------------------------------------------------------------------


def section_match(primary: Column, allowed: Column, on_page: Column, annexure_page: Column) -> Column:
    """How a candidate's page suits its parameter, by the parameter's primary section, its allowed ones (the first is the primary) and the page's.

    Parameters of the sections Tender Specific and Compliance may come from annexures, others not; without a primary section
    any page but an annexure's will do.
    """
    others = F.slice(allowed, 2, 100)
    return (
        F.when(primary.isNull(), F.when(annexure_page, "annexure_rejected").otherwise("unrestricted"))
        .when(annexure_page & ~primary.isin("Tender Specific", "Compliance"), "annexure_rejected")
        .when(F.array_contains(on_page, primary), "primary").when(F.arrays_overlap(others, on_page), "fallback").otherwise("section_mismatch")
    )


def context_violation(key: Column, context: Column, rules_: tuple[tuple[str, str, str | None, str], ...]) -> Column:
    """The reason of the first rule (key, forbidden pattern, allowed pattern, reason) whose key has a forbidden and no allowed context; else null."""
    out = F.lit(None).cast("string")
    for name, forbidden, fine, reason in reversed(rules_):
        excused = context.rlike(fine) if fine else F.lit(False)
        out = F.when((key == name) & context.rlike(forbidden) & ~excused, reason).otherwise(out)
    return out


def field_score(heading: Column, context: Column, source: Column, page: Column, labelled: Column, patterned: Column, bonus: Column, on_section: Column) -> Column:
    """At most 99: heading 25 (of .15), context 30 (of 1), table 20, label 8 or other 5, page 20 (of 15), keyword 15 or pattern 12, bonus 15, section 5."""
    parts = [
        F.least(F.lit(25.0), heading / 0.15 * 25), F.least(F.lit(30.0), context * 30), F.when(source == "table", 20).when(source == "label", 8).otherwise(5),
        F.least(F.lit(20.0), page / 15 * 20), F.when(labelled, 15).when(patterned, 12).otherwise(0), F.least(F.lit(15.0), bonus / 5), F.when(on_section, 5).otherwise(0),
    ]
    return F.least(F.lit(99), rounded(sum(parts, F.lit(0.0)))).cast("int")


def dynamic_filter(noise: Column, relevant: Column, type_match: Column, valid: Column, approved: Column, review: Column) -> Column:
    """struct<score, status>: 50, 20, 20 and 10 points, kept from 70 on; noise is rejected first."""
    score = F.when(relevant, 50).otherwise(0) + F.when(type_match, 20).otherwise(0) + F.when(valid, 20).otherwise(0) + F.when(approved, 10).otherwise(0)
    score = F.when(noise.isNotNull(), 0).otherwise(score)
    return F.struct(score.alias("score"), F.when(score < 70, "REJECT").when(review, "REVIEW").otherwise("VALID_DYNAMIC").alias("status"))


def experience_status(missing: Column) -> Column:
    return F.when(missing >= 2, "Not Eligible").when(missing == 1, "Partially Eligible").otherwise("Likely Eligible")
