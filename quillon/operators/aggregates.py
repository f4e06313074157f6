"""Aggregations: conditional measures in one scan, and counts filled with zeros over a fixed list of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sum_if(condition: Column, value: Column) -> Column:
    """A money sum over rows that meet a condition, to the cent; 0 without any."""
    return F.round(F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)), 2)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent to two places, 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 10000 + 0.5) / 100).otherwise(F.lit(0.0))


def zero_filled(counts: DataFrame, key: str, buckets: tuple[str, ...], measures: list[str]) -> DataFrame:
    """A row for every bucket, with 0 for measures that are missing; other buckets drop out."""
    spark: SparkSession = counts.sparkSession
    dim = spark.createDataFrame([(b, i) for i, b in enumerate(buckets)], f"{key} string, bucket_order int")
    return dim.join(counts, key, "left").select(key, "bucket_order", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Aggregates of one row each as one row."""
    out = one_row[0]
    for other in one_row[1:]:
        out = out.crossJoin(other)
    return out
