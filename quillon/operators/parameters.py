"""Parameters read from pages by eight families of patterns; every expression works inside the row of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The families in their order, with base confidence, and the patterns of names and values.
FAMILIES = {"chained": 93, "colon": 88, "dash": 84, "tabs": 86, "numbered": 90, "spaced": 80, "dots": 78, "pipe": 84, "anywhere": 72}
MANY_TABS = 82
MARKER = r"(?i)([A-Za-z][A-Za-z0-9\s/().&,'°#%\-]{1,95}?)\s*[:=–—\-]\s*"
NEXT_LABEL = r"[A-Za-z][A-Za-z0-9\s/().&,'°#%\-]{2,65}?\s*[:=–—\-]"
COLON = r"^([^\n]{2,100}?)\s*[:=]\s*([^\n]+)$"
DASH = r"^([A-Za-z][A-Za-z0-9\s/().&,'\-]{2,90}?)\s+-\s+([^\n]+)$"
NUMBERED = r"(?i)^(?:\d+[.)]\s*|[ivxlc]+[.)]\s*)?([A-Za-z][A-Za-z0-9\s/().&,'°#%\-]{1,95}?)\s*[:=]\s*([^\n]+)$"
SPACED = r"^([A-Za-z][^\d\n]{2,80}?)\s{2,}([^\n]+)$"
DOTS = r"^([A-Za-z][A-Za-z0-9\s/().&,'\-]{2,80}?)[\s.]{3,}([^\n]+)$"
PIPE, PIPE_HEAD = r"^\|?\s*([^|]{2,80}?)\s*\|\s*([^|]{1,500}?)\s*\|?\s*$", r"(?i)^(sr|s\.no|particulars)$"
ANYWHERE_PAIR = r"([A-Za-z][A-Za-z0-9\s/().&,'°#%\-]{1,90}?)\s*[:=–—\-]\s*([^:\n]{1,400}?)"
ANYWHERE = rf"(?i){ANYWHERE_PAIR}(?=\s+[A-Za-z][A-Za-z0-9\s/().&,'°#%\-]{{2,35}}?\s*[:=–—\-]|\n\n|$)"
ANYWHERE_PARTS = rf"(?i)^{ANYWHERE_PAIR}\z"
#: The same matches, as group 1, found faster. A name holds no mark but dashes, so a run of its other characters that no mark ends has no
#: name in it, nor has the head of a longer run than a name; such stretches are stepped over whole, and a name is begun only where a mark can follow.
_RUN, _MARK = r"A-Za-z0-9/().&,'°#%", r"[:=–—\-]"
ANYWHERE_SCAN = (
    rf"(?i)[{_RUN}\s]{{50}}(?=[{_RUN}\s]{{99}}[{_RUN}])|[{_RUN}\s]++(?!{_MARK})|((?=[{_RUN}\s]{{1,91}}+\s*+{_MARK}){ANYWHERE_PAIR.replace('(', '(?:', 1).replace('([^:', '(?:[^:')}"
    rf"(?=\s+[A-Za-z](?=[{_RUN}\s]{{0,36}}+\s*+{_MARK})[A-Za-z0-9\s/().&,'°#%\-]{{2,35}}?\s*{_MARK}|\n\n|$))"
)
NOISE_NAME = r"(?i)^(?:page\s*no\.?|index|schedule|sl\.?\s*no\.?|sr\.?\s*no\.?|\d+)$"
#: What a line must have for a family to be tried on it: a look at these is far cheaper than the pattern itself.
NEEDS = {"chained": "[:=–—-]", "colon": "[:=]", "dash": r"\s-\s", "numbered": "[:=]", "spaced": r"\s\s", "dots": r"[\s.][\s.][\s.]", "pipe": r"\|", "anywhere": "[:=–—-]"}
ONLY_MONEY, ONLY_RULES = r"(?i)^[\d.,\s₹RsINR]+$", r"^[\s|+\-=_.]+$"
LONGEST_VALUE = 1200


def clean_name(raw: Column) -> Column:
    """A name without numbering and bullets; null if too short or long, noise, or without a letter."""
    name = F.regexp_replace(raw, r"\s+", " ")
    for mark in (r"^[\d]+[.)\]]\s*", r"^[(\[]\d+[)\]]\s*", r"^[*•\-]\s*"):
        name = F.regexp_replace(name, mark, "")
    name = F.trim(name)
    return F.when(F.char_length(name).between(2, 110) & ~name.rlike(NOISE_NAME) & name.rlike("[A-Za-z]") & ~name.rlike(ONLY_MONEY), name)


def clean_value(raw: Column) -> Column:
    value = F.substr(F.trim(F.regexp_replace(raw, r"\s+", " ")), F.lit(1), F.lit(LONGEST_VALUE))
    return F.when((value != "") & ~value.rlike(ONLY_RULES), value)


def before_next_label(value: Column) -> Column:
    """A value up to where the next label begins, unless that is its very start."""
    cut = F.regexp_extract(value, rf"(?is)^(.+?)\s+{NEXT_LABEL}", 1)
    return F.trim(F.when((cut != "") & ~value.rlike(rf"(?i)^\s+{NEXT_LABEL}"), cut).otherwise(value))


def _found(family: str, i: Column, name: Column, value: Column, base=None) -> Column:
    order = list(FAMILIES).index(family)
    return F.struct(F.lit(order).alias("order"), F.lit(family).alias("family"), i.cast("int").alias("i"), name.alias("name"), value.alias("value"), (F.lit(FAMILIES[family]) if base is None else base).alias("base"))


def _one(family: str, line: Column, pattern: str, cut: bool = True) -> Column:
    name, value = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    keep = line.rlike(NEEDS[family]) & (name != "")
    if family == "pipe":
        keep = keep & ~F.trim(name).rlike(PIPE_HEAD)
    return F.when(keep, F.array(_found(family, F.lit(0), name, before_next_label(value) if cut else value)))


def line_matches(line: Column) -> Column:
    """What all families of one line find in a trimmed line, in their order."""
    labels, pieces = F.regexp_extract_all(line, F.lit(MARKER), F.lit(1)), F.split(line, MARKER)
    chained = F.transform(labels, lambda label, i: _found("chained", i, label, before_next_label(F.element_at(pieces, i + 2))))
    cells = F.filter(F.transform(F.split(line, "\t"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(cells) / 2).cast("int") - 1), lambda i: _found("tabs", i, F.element_at(cells, 2 * i + 1), F.element_at(cells, 2 * i + 2), F.when(F.size(cells) == 2, FAMILIES["tabs"]).otherwise(MANY_TABS)))
    tabs = F.when(F.contains(line, F.lit("\t")) & (F.size(cells) >= 2) & (F.size(cells) % 2 == 0), pairs)
    ways = [F.when(line.rlike(NEEDS["chained"]) & (F.size(labels) > 0), chained), _one("colon", line, COLON), _one("dash", line, DASH), tabs, _one("numbered", line, NUMBERED), _one("spaced", line, SPACED), _one("dots", line, DOTS, cut=False), _one("pipe", line, PIPE, cut=False)]
    return F.flatten(F.array_compact(F.array(*ways)))


def anywhere_matches(text: Column) -> Column:
    """Names and values anywhere in a page, across its lines; the last family.

    The page is searched once, for whole matches of ``ANYWHERE``. A match is then taken apart by the same pattern held to its end: any
    other way to that end would have ended a match in the page as well, so name and value are those found there.
    """
    def parts(match: Column, i: Column) -> Column:
        return _found("anywhere", i, F.regexp_extract(match, ANYWHERE_PARTS, 1), before_next_label(F.regexp_extract(match, ANYWHERE_PARTS, 2)))

    matches = F.filter(F.regexp_extract_all(text, F.lit(ANYWHERE_SCAN), F.lit(1)), lambda m: m != "")
    return F.when(text.rlike(NEEDS["anywhere"]), F.transform(matches, parts))


def page_parameters(pages: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """(doc_id, page, family, name, value, confidence) of pages (doc_id, page, text): each different name and value of a page once.

    The first one seen counts: by line, family and place in the line, matches across lines last. Confidence is the family's, 8
    more on the first five pages and 4 more up to the fifteenth, 99 at most. Null texts have no parameters.
    """
    # patterns cost far more than a shuffle of the pages, so they don't hang on how few row groups the pages are read from
    pages = pages.select("doc_id", "page", "text").repartition("doc_id", "page")
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\r?\n")).alias("line", "said")).withColumn("said", F.trim("said")).where(F.char_length("said") >= 2)
    rows = lines.select("doc_id", "page", "line", F.explode(line_matches(F.col("said"))).alias("m"))
    if "anywhere" in families:
        # an outer explode: before an inner one the optimizer asks for the array's size, which searches the page again
        found = pages.select("doc_id", "page", F.lit((1 << 31) - 1).alias("line"), F.explode_outer(anywhere_matches(F.col("text"))).alias("m"))
        rows = rows.unionByName(found.where("m is not null"))
    rows = rows.select("doc_id", "page", "line", "m.*").where(F.col("family").isin(*families))
    rows = rows.withColumns({"name": clean_name(F.col("name")), "value": clean_value(F.col("value"))}).where("name is not null and value is not null")
    first = F.min(F.struct("line", "order", "i", "family", "name", "value", "base")).alias("f")
    kept = rows.groupBy("doc_id", "page", F.lower("name").alias("n"), F.lower("value").alias("v")).agg(first).select("doc_id", "page", "f.*")
    boost = F.when(F.col("page") <= 5, 8).when(F.col("page") <= 15, 4).otherwise(0)
    return kept.select("doc_id", "page", "family", "name", "value", F.least(F.lit(99), F.col("base") + boost).alias("confidence"))
