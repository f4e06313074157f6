"""Rules that are a table: patterns by field, known only when a job runs."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that one job takes; more than a table of rules by hand has.
MOST_RULES = 10_000


def usable(rules: DataFrame) -> list:
    """The active rules whose pattern compiles, by priority and then number; each pattern is checked once, bad ones are left out.

    Rules are what people have written, so they are few; more than ``MOST_RULES`` raise.
    """
    pattern = rules.sparkSession._jvm.java.util.regex.Pattern
    rows = rules.where("active and pattern is not null").select("field", "rule_id", "pattern", "priority", "confidence").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kept = []
    for row in sorted(rows, key=lambda r: (r.priority, r.rule_id)):
        try:
            pattern.compile(row.pattern)
            kept.append(row)
        except IllegalArgumentException:  # what a pattern's syntax error is here
            continue
    return kept


def best_matches(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, rule_id, confidence): of each field the rule of highest confidence that matches a line; by priority where they tie.

    All rules unfold in one pass over each text, as compiled predicates over its lines. Fields without a match have no row.
    """
    lines = F.split(F.col(text), "\n")
    found = []
    for place, rule in enumerate(usable(rules)):
        hit = _holds(lines, rule.pattern)
        found.append(F.when(hit, F.struct(F.lit(rule.field).alias("field"), (-F.lit(rule.confidence)).alias("c"), F.lit(place).alias("place"), F.lit(rule.rule_id).alias("rule_id"))))
    if not found:
        return texts.select(key, F.lit("").alias("field"), F.lit(0).alias("rule_id"), F.lit(0).alias("confidence")).limit(0)
    rows = texts.select(key, F.explode(F.array_compact(F.array(*found))).alias("m")).select(key, "m.*")
    best = F.min(F.struct("c", "place", "rule_id")).alias("b")
    return rows.groupBy(key, "field").agg(best).select(key, "field", "b.rule_id", (-F.col("b.c")).alias("confidence"))


def _holds(lines, pattern: str):
    return F.exists(lines, lambda line: line.rlike(pattern))
