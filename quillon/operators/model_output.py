"""Rows from the free-form output of a language model: JSON if it is some, else the block between its outermost braces.

The output is a VARIANT, so rows with odd types or missing fields parse like others and are judged field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as no value, names that are no parameters, and the confidence below which a row goes.
NO_VALUE = ("", "null", "n/a", "na", "not found", "-")
NO_PARAMETER = r"(?i)^(?:annexure|index|table\s+of\s+contents|checklist|page\s+number|footer|header|page\s+\d)|\bpage\s+\d+\s+of\s+\d+\b"
LONGEST_NAME, LEAST_CONFIDENCE, BASE_CONFIDENCE, IN_TEXT, DIGIT, MOST = 200, 55, 72, 12, 3, 98


def parsed(raw: Column) -> Column:
    """The JSON of an output as a VARIANT; null if neither all of it nor the block from its first to its last brace is some."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def _text(row: Column, field: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(row, f"$.{field}", "string"), F.lit("")))


def _number(text: Column, keep: str) -> Column:
    return F.regexp_replace(text, keep, "").try_cast("double")


def output_rows(outputs: DataFrame, raw: str = "raw", text: str = "text", first: str = "first_page", last: str = "last_page") -> DataFrame:
    """(output_id, place, parameter, value, page, confidence) of the rows in ``parameters`` of each output.

    A row needs a name of 1 to 200 characters with a letter or digit that names no page furniture, and a value. A page outside
    the chunk's becomes its first. A stated confidence of 50 or more counts, else one follows from the evidence: 72, 12 more for a value that
    stands in the text, 3 for a digit; 98 at most, rows under 55 go. Of equal page, name and value the first stays. Outputs that are no JSON, or have no such list, have no rows.
    """
    items = F.try_variant_get(parsed(F.col(raw)), "$.parameters", "array<variant>")
    rows = outputs.select("output_id", F.col(text).alias("_text"), F.col(first).alias("_first"), F.col(last).alias("_last"), F.posexplode(items).alias("place", "_row"))
    row = F.col("_row")
    page = _number(_text(row, "page"), r"[^\d]")
    rows = rows.select("*", _text(row, "parameter").alias("parameter"), _text(row, "value").alias("value"), page.alias("_page"), F.floor(_number(_text(row, "confidence"), r"[^\d.]") + 0.5).alias("_stated"))
    rows = rows.where(F.char_length("parameter").between(1, LONGEST_NAME) & F.col("parameter").rlike("[A-Za-z0-9]") & ~F.col("parameter").rlike(NO_PARAMETER) & ~F.lower("value").isin(*NO_VALUE))
    held = F.contains(F.lower(F.coalesce("_text", F.lit(""))), F.lower("value"))
    guess = F.lit(BASE_CONFIDENCE) + F.when(held, IN_TEXT).otherwise(0) + F.when(F.col("value").rlike(r"\d"), DIGIT).otherwise(0)
    confidence = F.least(F.lit(MOST), F.when(F.col("_stated") >= 50, F.col("_stated")).otherwise(guess)).cast("int")
    inside = F.when(F.col("_page").between(F.col("_first"), F.col("_last")), F.col("_page")).otherwise(F.col("_first")).cast("int")
    rows = rows.select("output_id", "place", "parameter", "value", inside.alias("page"), confidence.alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
    kept = rows.groupBy("output_id", "page", F.lower("parameter").alias("_p"), F.lower("value").alias("_v")).agg(F.min(F.struct("place", "parameter", "value", "confidence")).alias("f"))
    return kept.select("output_id", "f.place", "f.parameter", "f.value", "page", "f.confidence")
