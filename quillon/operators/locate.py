"""Fields located in pages: every occurrence of a label with its place, and what stands near it.

A page is a row, and everything near a label lies in its page, so occurrences, distances and contexts are arrays and substrings
inside the row: nothing is joined to find them. Only the choice of a document's winner shuffles, and it combines before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels in order of priority, patterns of contexts and amounts, distances in characters.
DEPOSIT_LABELS = ("EMD Amount", "Amount of EMD", "Earnest Money Deposit", "Earnest Money", "Bid Security", "Security Deposit", "EMD")
VALUE_LABELS = (
    "Estimated Cost of Work", "Estimated Cost", "Tender Value", "Tender Amount", "Estimated Tender Value", "Contract Value", "Approximate Cost of Work", "Approximate Cost",
    "Cost of Work", "Project Cost",
)
AMOUNT = r"(?i)(?:₹|Rs\.?|INR)\s*:?\s*([0-9]{1,3}(?:,[0-9]{2,3}){1,5})"
DEPOSIT_CONTEXT = r"(?i)\b(?:EMD|Earnest\s+Money(?:\s+Deposit)?|Bid\s+Security|Security\s+Deposit)\b"
DEPOSIT_REJECT = r"(?i)(?:financial\s+statement|balance\s+sheet|turnover\s+requirement|annual\s+turnover|work\s+order|experience\s+clause|years?\s+of\s+experience|annexure|appendix|schedule\s+[ivx\d]+)"
DEPOSIT_STRONG = r"(?i)EMD\s+Amount|Earnest\s+Money|Amount\s+of\s+EMD"
VALUE_CONTEXT = r"(?i)\b(?:Estimated\s+Cost|Tender\s+Value|Tender\s+Amount|Contract\s+Value|Approximate\s+Cost|Cost\s+of\s+Work|Project\s+Cost)\b"
VALUE_REJECT = r"(?i)(?:experience\s+section|experience\s+requirement|years?\s+of\s+experience|turnover\s+requirement|annual\s+turnover|minimum\s+turnover|financial\s+capacity|previous\s+work\s+order|work\s+order\s+value|annexure|appendix|bank\s+statement|balance\s+sheet|financial\s+statement|net\s+worth|bid\s+capacity)"
STATED_VALUE = r"(?i)(?:Estimated\s+Cost(?:\s+of\s+Work)?|Tender\s+Value|Contract\s+Value)\s*[:–\-]?\s*(?:₹|Rs\.?|INR)\s*:?\s*([0-9]{1,3}(?:,[0-9]{2,3}){1,5})"
DEPOSIT_PERCENT = r"(?i)\bEMD\s*[@]?\s*(\d+(?:\.\d+)?)\s*%"
FOLLOWS, RADIUS, TOLERANCE, SCORE = 120, 200, 0.05, 92


def low(text: Column) -> Column:
    """A-Z in lower case: as long as the text, so places in one are places in the other."""
    return F.translate(text, UPPER, LOWER)


def places(text: Column, term: str) -> Column:
    """The number of characters before each occurrence, in order, of a term that does not overlap itself."""
    count = ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")
    before = F.transform(F.sequence(F.lit(1), count), lambda i: F.char_length(F.call_function("substring_index", text, F.lit(term), i)))
    return F.when(count > 0, before).otherwise(F.array().cast("array<int>"))


def occurrences(pages: DataFrame, labels: tuple[str, ...], text: str = "text") -> DataFrame:
    """``pages`` with one row for each occurrence of a label: label, priority (from 1), at (characters before it) and stop (before what follows)."""
    def every(label: str, priority: int) -> Column:
        return F.transform(places(F.col("_low"), label.lower()), lambda at: F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), at.alias("at"), (at + len(label)).alias("stop")))

    found = [every(label, k) for k, label in enumerate(labels, 1)]
    return pages.withColumn("_low", low(F.col(text))).withColumn("_o", F.explode(F.flatten(F.array(*found)))).select(*pages.columns, "_o.*")


def _is_word(c: Column) -> Column:
    return c.rlike(r"^\w$")


def digits(part: Column) -> Column:
    return F.regexp_replace(part, ",", "").try_cast("double")


def around(text: Column, center: Column, radius: int = RADIUS) -> Column:
    """The characters around a place, white space collapsed."""
    start = F.greatest(center - radius, F.lit(0))
    cut = F.substr(text, start + 1, F.least(F.char_length(text), center + radius) - start)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def page_weight(page: Column) -> Column:
    return F.when(page <= 10, 100).when(page <= 20, 50).otherwise(10)


def page_confidence(score, page: Column) -> Column:
    return F.least(F.lit(100), F.lit(score) + F.when(page <= 2, 15).when(page <= 5, 10).otherwise(0))


def stated_amounts(pages: DataFrame, labels: tuple[str, ...], short: int, whole: tuple[str, ...]) -> DataFrame:
    """(doc_id, page, label, priority, at, part, value, context): labels with an amount within reach behind them.

    A label inside a longer word counts only from ``short`` characters on; ``whole`` ones must also end a word.
    """
    t = F.col("text")
    rows = occurrences(pages.select("doc_id", "page", "text"), labels)
    opens = (F.col("at") == 0) | ~_is_word(F.substr(t, F.col("at"), F.lit(1))) | (F.char_length("label") >= short)
    ends = ~_is_word(F.substr(t, F.col("stop") + 1, F.lit(1))) | ~F.col("label").isin(*whole) if whole else F.lit(True)
    part = F.regexp_extract(F.substr(t, F.col("stop") + 1, F.lit(FOLLOWS)), AMOUNT, 1)
    rows = rows.where(opens & ends).withColumn("part", part).where(F.char_length(F.replace("part", F.lit(","), F.lit(""))) >= 4)
    center = F.col("at") + F.floor(F.char_length("label") / 2).cast("int")
    return rows.select("doc_id", "page", "label", "priority", "at", "part", digits(F.col("part")).alias("value"), around(t, center).alias("context"))


def _first_of(pattern: str, name: str) -> Column:
    """The first match on a document's pages, as a number."""
    part = F.regexp_extract("text", pattern, 1)
    return F.min(F.when(part != "", F.struct("page", digits(part).alias("v"))))["v"].alias(name)


def _near(value: Column, expected: Column) -> Column:
    return (expected > 0) & (F.abs(value - expected) / expected <= TOLERANCE)


ORDER = ("priority", "weight", "page", "at")


def located_deposits(pages: DataFrame) -> DataFrame:
    """(doc_id, amount, page, label, confidence, rule): the deposit of each document that states one.

    Labels win by priority, page weight, page and place, never by the amount. A stated percentage of the stated value lifts an
    amount within five percent of it to full confidence, and may make it the winner. Null ids are one document; null texts have no statement.
    """
    facts = pages.groupBy("doc_id").agg(_first_of(STATED_VALUE, "stated"), _first_of(DEPOSIT_PERCENT, "percent"))
    hits = stated_amounts(pages, DEPOSIT_LABELS, 12, ("EMD",))
    known = hits.join(facts.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
    ctx = F.col("context")
    late = (F.col("priority") >= 7) & (F.col("page") > 20) & ~ctx.rlike(DEPOSIT_STRONG)
    too_much = F.coalesce((F.col("stated") > 0) & (F.col("value") > F.col("stated") * 0.2), F.lit(False))
    known = known.withColumns({
        "accepted": ~ctx.rlike(DEPOSIT_REJECT) & ctx.rlike(DEPOSIT_CONTEXT) & ~too_much & ~late,
        "fits": F.coalesce(_near(F.col("value"), F.floor(F.col("stated") * F.col("percent") / 100 + 0.5).cast("double")), F.lit(False)), "weight": -page_weight(F.col("page")),
    })
    row = ("part", "label")
    by_rank, by_place = F.struct(*ORDER, *row), F.struct("page", "priority", "at", *row)
    best = known.groupBy("doc_id").agg(
        F.min(F.when(F.col("accepted"), by_rank)).alias("best"), F.min(F.when(F.col("accepted") & F.col("fits"), by_place)).alias("fit"), F.min(F.when(F.col("fits"), by_place)).alias("any_fit"))
    fit = F.when(F.col("best").isNull(), F.col("any_fit")).otherwise(F.col("fit"))
    by_percent = F.when(F.col("best").isNull(), fit.isNotNull()).otherwise(F.coalesce((fit["part"] == F.col("best.part")) | (fit["priority"] <= 4), F.lit(False)))
    same = F.coalesce(fit["part"] == F.col("best.part"), F.lit(False))
    use_fit = by_percent & ~same
    pick = lambda name: F.when(use_fit, fit[name]).otherwise(F.col("best")[name])
    rule = F.when(F.col("best").isNull(), "percentage_rule").when(by_percent, "percentage_validated").otherwise("explicit_statement")
    rows = best.where(F.col("best").isNotNull() | fit.isNotNull())
    return rows.select("doc_id", F.concat(F.lit("Rs. "), pick("part")).alias("amount"), pick("page").alias("page"), pick("label").alias("label"), F.when(by_percent, 100).otherwise(page_confidence(SCORE, pick("page"))).alias("confidence"), rule.alias("rule"))


def located_values(pages: DataFrame) -> DataFrame:
    """(doc_id, amount, page, label, confidence, rule): the value of each document that states one.

    A value of which the stated deposit is the stated percentage, within five percent, wins with full confidence; else labels
    win by priority, page weight, page and place.
    """
    deposits = stated_amounts(pages, DEPOSIT_LABELS, 12, ("EMD",)).where("value > 0 and value < 5e8")
    deposit = deposits.groupBy("doc_id").agg(F.min(F.struct("priority", "page", "at", "value"))["value"].alias("deposit"))
    percent = pages.groupBy("doc_id").agg(_first_of(DEPOSIT_PERCENT, "percent")).where("percent > 0")
    facts = deposit.join(percent, deposit["doc_id"].eqNullSafe(percent["doc_id"])).select(deposit["doc_id"].alias("_d"), F.floor(F.col("deposit") * 100 / F.col("percent") + 0.5).cast("double").alias("expected"))
    hits = stated_amounts(pages, VALUE_LABELS, 1000, ())
    hits = hits.where(~F.col("context").rlike(VALUE_REJECT) & F.col("context").rlike(VALUE_CONTEXT))
    known = hits.join(facts, F.col("doc_id").eqNullSafe(F.col("_d")), "left").withColumn("weight", -page_weight(F.col("page")))
    fits = F.coalesce(_near(F.col("value"), F.col("expected")), F.lit(False))
    best = known.groupBy("doc_id").agg(F.min(F.struct(*ORDER, "part", "label")).alias("best"), F.min(F.when(fits, F.struct("page", "priority", "at", "part", "label"))).alias("fit"))
    # of hits with the amount that fits, the first in the order of pages is the winner
    pick = lambda name: F.coalesce(F.col("fit")[name], F.col("best")[name])
    rule = F.when(F.col("fit").isNotNull(), "emd_cross_validated").otherwise("explicit_statement")
    return best.select("doc_id", F.concat(F.lit("Rs. "), pick("part")).alias("amount"), pick("page").alias("page"), pick("label").alias("label"), F.when(F.col("fit").isNotNull(), 100).otherwise(page_confidence(SCORE, pick("page"))).alias("confidence"), rule.alias("rule"))


def located_blocks(pages: DataFrame, labels: tuple[str, ...], strong: str, stops: str, length: int = 500) -> DataFrame:
    """(doc_id, value, page, confidence): the block behind a label, up to a stop marker, cleaned and joined.

    Winners by confidence, then the longer value, then the page. Blocks of under 8 or over 500 characters or over 80 words don't count.
    """
    t = F.col("text")
    rows = occurrences(pages.select("doc_id", "page", "text"), labels)
    rows = rows.where(((F.col("at") == 0) | ~_is_word(F.substr(t, F.col("at"), F.lit(1)))) & ~_is_word(F.substr(t, F.col("stop") + 1, F.lit(1))))
    tail = F.regexp_replace(F.substr(t, F.col("stop") + 1), r"^[\s:.\-–—]*", "")
    block = F.regexp_replace(F.substr(tail, F.lit(1), F.lit(length)), f"(?is)(?:{stops}).*$", "")
    value = F.trim(F.regexp_replace(F.regexp_replace(block, r"[,–—\-]+", " "), r"\s+", " "))
    score = F.when(F.contains(low(F.col("label")), F.lit(strong)), 95).otherwise(85)
    rows = rows.select("doc_id", "page", "at", value.alias("value"), page_confidence(0, F.col("page")).alias("bonus"), score.alias("score"))
    rows = rows.where(F.char_length("value").between(8, 500) & (F.size(F.split("value", " ")) <= 80)).withColumn("confidence", F.least(F.lit(100), F.col("bonus") + F.col("score")))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.char_length("value")).alias("n"), "page", "at", "value")).alias("b")
    return rows.groupBy("doc_id").agg(best).select("doc_id", "b.value", "b.page", (-F.col("b.c")).alias("confidence"))


# what a text says without a model: the first pattern, label or keyword that has something


def first_pattern(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first matching pattern captures, white space collapsed; empty without one."""
    found = [F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"\s+", " ")) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


#: An amount behind a label, at most 40 characters away, or behind a colon.
NEAR_AMOUNT = r"(?i){0}[^\d₹]{{0,40}}((?:Rs\.?|INR|₹)?\s*[\d,]+(?:\.\d+)?\s*(?:Cr|Crore|crores|Lakh|Lac|lakhs)?)"
COLON_AMOUNT = r"(?i){0}\s*[:\-]\s*((?:Rs\.?|INR|₹)?\s*[\d,]+(?:\.\d+)?\s*(?:Cr|Crore|Lakh|Lac)?)"
ANSWER = r"(?i){0}[^\n]{{0,60}}?\b(yes|no|required|not required|applicable|not applicable)\b"
MANDATORY = r"(?i){0}[^\n]{{0,20}}(?:is\s+)?mandatory"
ITEM_BREAK = r"\n|(?:\d+\.)|(?:\([a-z]\))|(?:•)|(?:-)"


def near_amount(text: Column, labels: tuple[str, ...]) -> Column:
    """The amount near the first label that has one; empty without one."""
    found = [F.regexp_extract(text, p.format(label), 1) for label in labels for p in (NEAR_AMOUNT, COLON_AMOUNT)]
    return F.coalesce(*[F.when(f != "", F.trim(f)) for f in found], F.lit(""))


def answer(text: Column, keywords: tuple[str, ...]) -> Column:
    """Yes or No as the first keyword with an answer within 60 characters of its line says, or Yes if it is mandatory; empty without one."""
    ways = []
    for k in keywords:
        said = F.lower(F.regexp_extract(text, ANSWER.format(k), 1))
        ways += [F.when(said.isin("yes", "required", "applicable"), "Yes").when(said.isin("no", "not required", "not applicable"), "No"), F.when(text.rlike(MANDATORY.format(k)), "Yes")]
    return F.coalesce(*ways, F.lit(""))


def listed(text: Column, keywords: tuple[str, ...]) -> Column:
    """Up to six items behind the first occurrence of each keyword, from the 1200 characters there."""
    made = []
    for k in keywords:
        at = F.instr(low(text), k)
        items = F.transform(F.split(F.substr(text, at, F.lit(1200)), ITEM_BREAK), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
        kept = F.filter(items, lambda x: F.char_length(x).between(4, 179) & ~x.rlike(r"(?i)^page\s+\d"))
        made.append(F.when(at > 0, F.slice(kept, 1, 6)).otherwise(F.array().cast("array<string>")))
    return F.concat(*made)
