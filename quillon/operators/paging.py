"""Sorting by custom orders, pages and merged top rows. All sorts end in a unique key, so pages are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 20, clamp: bool = True) -> DataFrame:
    """One page of an order; page numbers start at 1 and limits lie in 1..100 unless not clamped."""
    number = max(1, number)
    limit = min(100, max(1, limit)) if clamp else limit
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_count(df: DataFrame, limit: int) -> DataFrame:
    """(total, total_pages), at least one page."""
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long"))


def merged_top(parts: list[DataFrame], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of several sources, each cut to its share before the merge."""
    share = -(-limit // len(parts))
    cut = [p.orderBy(*order).limit(share) for p in parts]
    out = cut[0]
    for other in cut[1:]:
        out = out.unionByName(other)
    return out.orderBy(*order).limit(limit)


def severity(priority: Column) -> Column:
    """Rank of a priority: critical, high, medium, low, others."""
    return F.when(priority == "critical", 0).when(priority == "high", 1).when(priority == "medium", 2).when(priority == "low", 3).otherwise(4)
