"""Sections of a document's pages, scored by keywords, headings and titles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

#: Each section with its keywords, patterns of headings, and patterns of table titles.
DEFINITIONS = (
    ("Identity", (
        "tender number", "nit number", "nit no", "e-tender", "eprocurement", "organization", "organisation", "department", "tender title", "name of work", "inviting authority", "tender reference", "bid reference",
        "location", "place of work", "issuing authority"),
     (r"notice\s+inviting\s+tender", r"\bnit\b", r"tender\s+notice", r"general\s+information", r"tender\s+particulars", r"particulars\s+of\s+tender"), (r"tender\s+details", r"nit\s+details", r"general\s+particulars")),
    ("Financial", (
        "tender value", "estimated cost", "project cost", "contract value", "earnest money", "emd", "tender fee", "document fee", "bid security", "security deposit", "performance security", "performance guarantee",
        "bank guarantee", "payment terms", "price bid", "financial bid"),
     (r"financial\s+(?:bid|particulars|conditions?)", r"earnest\s+money", r"\bemd\b", r"tender\s+fee", r"cost\s+of\s+tender"), (r"financial\s+summary", r"fee\s+details", r"emd\s+details")),
    ("Timeline", (
        "publishing date", "pre-bid", "pre bid", "bid start", "bid end", "last date", "submission deadline", "bid opening", "technical opening", "financial opening", "completion period", "contract period",
        "time schedule", "important dates", "schedule of dates"),
     (r"important\s+dates?", r"schedule\s+of\s+(?:dates|bid)", r"bid\s+schedule", r"time\s+schedule", r"key\s+dates"), (r"date\s+schedule", r"bid\s+timeline")),
    ("Eligibility", (
        "eligibility", "qualification criteria", "pre-qualification", "turnover", "annual turnover", "experience requirement", "net worth", "bid capacity", "manpower requirement", "minimum qualification", "bidder eligibility"),
     (r"eligibility\s+criteria", r"qualification\s+criteria", r"pre[\s-]?qualification", r"qualifying\s+requirements"), (r"eligibility\s+table", r"qualification\s+requirements")),
    ("Compliance", (
        "gst", "pan", "msme", "epf", "esic", "pf registration", "esi registration", "labour license", "labour licence", "iso certification", "bank solvency", "statutory compliance", "declaration", "integrity pact"),
     (r"compliance\s+requirements?", r"statutory\s+requirements?", r"legal\s+requirements?", r"\bgst\b", r"registration\s+requirements"), (r"compliance\s+checklist", r"statutory\s+documents")),
    ("Experience", ("work order", "completion certificate", "experience certificate", "past projects", "similar work", "client reference", "past performance", "completed projects", "proof of experience"),
     (r"experience\s+requirements?", r"similar\s+works?", r"past\s+experience", r"work\s+experience"), (r"experience\s+details", r"list\s+of\s+works")),
    ("Scope", ("scope of work", "scope of services", "deliverables", "deployment", "activities", "responsibilities", "nature of work", "statement of work", "services to be provided", "job description"),
     (r"scope\s+of\s+(?:work|services?|contract)", r"statement\s+of\s+work", r"nature\s+of\s+work", r"description\s+of\s+(?:work|services)"), (r"scope\s+summary", r"deliverables")),
    ("Technical Specifications", (
        "technical specification", "technical requirements", "technical bid", "equipment", "machinery", "software", "hardware", "network", "performance standards", "make and model", "technical compliance"),
     (r"technical\s+specifications?", r"technical\s+requirements?", r"technical\s+bid", r"equipment\s+specification"), (r"technical\s+data", r"specification\s+sheet")),
    ("Tender Specific", (
        "maf", "oem authorization", "oem authorisation", "reverse auction", "make in india", "mse preference", "gem conditions", "psara", "special conditions", "particular conditions", "purchase preference", "ebg", "epbg"),
     (r"special\s+conditions?", r"particular\s+conditions?", r"tender\s+specific", r"make\s+in\s+india", r"reverse\s+auction"), (r"special\s+requirements", r"gem\s+conditions")),
    ("Annexures", ("annexure", "appendix", "enclosure", "form no", "format no", "undertaking", "integrity pact", "declaration form", "bid form", "proforma", "specimen format"),
     (r"(?m)^annexure\s+[a-z0-9ivxlc]+", r"(?m)^appendix\s+[a-z0-9ivxlc]+", r"integrity\s+pact", r"undertaking", r"declaration\s+form", r"bid\s+form"), (r"form\s+for", r"format\s+for")),
)
#: Scores, the least one, the least confidence, and what a page without any section counts as.
HEAD_CHARS, PATTERN, HEADING, TITLE, LEAST, LEAST_CONFIDENCE, FALLBACK = 5000, 8, 10, 6, 4, 35, 45
EARLY = {**dict.fromkeys(("Identity", "Financial", "Timeline"), (5, 6)), **dict.fromkeys(("Eligibility", "Scope", "Compliance"), (20, 3))}


def heads(pages: DataFrame) -> DataFrame:
    """(doc_id, page, head, low, plain, headings, titles): what sections are read from, worked out once a page.

    The first 5000 characters, the same in lower case and, for plain searches, without the long s; its headings, and these as one text.
    """
    made = pages.select("doc_id", "page", F.substring("text", 1, HEAD_CHARS).alias("head"), tx.headings(F.col("text")).alias("headings")).withColumn("low", F.lower("head"))
    plain = lambda c: F.replace(c, F.lit("ſ"), F.lit("s"))
    return made.withColumns({"plain": plain(F.col("low")), "titles": plain(F.lower(F.array_join("headings", "\n")))})


def section_score(name: str, keywords, patterns, titles) -> Column:
    """The score of a section on a page of ``heads``: its keywords, patterns and titles of tables, headings that its patterns match, and early pages.

    A pattern is tried only where its longest word stands: a plain search is far cheaper.
    """
    page, head, headings = (F.col(x) for x in ("page", "head", "headings"))
    where = lambda text, p, points: F.when(F.contains(F.col(text), F.lit(tx.needed(p))), points).otherwise(0)
    found = lambda p, points: where("plain", p, F.when(head.rlike(tx.portable(f"(?i){p}")), points).otherwise(0))
    until, boost = EARLY.get(name, (0, 0))
    parts = [tx.hits_in(F.col("low"), k) * tx.keyword_weight(k) for k in keywords] + [found(p, PATTERN) for p in patterns] + [found(t, TITLE) for t in titles]
    parts += [where("titles", p, HEADING * F.size(F.filter(headings, _matches(p)))) for p in patterns]
    return sum(parts, F.when(page <= until, boost).otherwise(0)).cast("int")


def _matches(pattern: str):
    return lambda h: h.rlike(tx.portable(f"(?i){pattern}"))


def confidence_of(score: Column, section: Column, page: Column) -> Column:
    base = F.least(F.lit(99), F.greatest(F.lit(LEAST_CONFIDENCE), F.floor(40 + score * 2.5 + 0.5)))
    return F.when((section == "Annexures") & (page <= 5), F.greatest(F.lit(LEAST_CONFIDENCE), base - 15)).otherwise(base).cast("int")


def fallback(page: Column) -> Column:
    """The section of a page on which none is found."""
    return F.when(page <= 5, "Identity").when(page <= 20, "Eligibility").otherwise("Scope")
