"""Predicates and filters; each is a column or a narrowing of a DataFrame, so it pushes down where the source allows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_equal(col: Column, value) -> Column:
    """Not equal, which a missing value also is."""
    return ~col.eqNullSafe(F.lit(value))


def date_range(col: Column, start: str | None, end: str | None) -> Column:
    """From ``start`` to the end of the day of ``end``, both included; either may be open."""
    kept = F.lit(True)
    if start:
        kept = kept & (col >= F.lit(start).cast("timestamp"))
    if end:
        kept = kept & (col < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return kept


def matches(col: Column, term: str, literal: bool = False) -> Column:
    """Case-insensitive search; the term is a pattern as users type it, or plain text where ``literal``."""
    return col.rlike("(?i)" + (re.escape(term) if literal else term))


def search(df: DataFrame, term: str, columns: list[str], exact: bool = False, least: int = 2) -> DataFrame:
    """Rows in which any of the columns equals or contains the term; terms of under ``least`` characters find nothing."""
    term = term.strip()
    if len(term) < least:
        return df.where(F.lit(False))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c) == term if exact else matches(F.col(c), term, literal=True), F.lit(False))
    return df.where(hit)


def filled(col: Column) -> Column:
    """Present and not an empty string."""
    return col.isNotNull() & (col != "")


def own_rows(df: DataFrame, user_id: int | None, owners: list[str]) -> DataFrame:
    """Rows that belong to the user by any owner column; all rows where no user is given."""
    if user_id is None:
        return df
    hit = F.lit(False)
    for c in owners:
        hit = hit | F.col(c).eqNullSafe(F.lit(user_id))
    return df.where(hit)


def category_label(raw: Column) -> Column:
    """Display label of a service category; everything else, and nothing, is ``Other Categories``."""
    known = {"Security Services": "Security", "Housekeeping Services": "Housekeeping", "Manpower Services": "Manpower", "Horticulture": "Horticulture", "Facility Management": "Facility Management"}
    out = F.lit("Other Categories")
    for name, label in known.items():
        out = F.when(raw == name, label).otherwise(out)
    return out


def expiry_status(days: Column, current: Column) -> Column:
    """Released stays; no date: the current status or Active; past: Expired; within 30 days: Expiring Soon; else Active."""
    return (
        F.when(current == "Released", current)
        .when(days.isNull(), F.coalesce(current, F.lit("Active")))
        .when(days < 0, "Expired").when(days <= 30, "Expiring Soon").otherwise("Active")
    )


def requirement_status(required: Column, tracked: Column) -> Column:
    return (
        F.when(required <= 0, F.when(tracked > 0, "complete").otherwise("not_required"))
        .when(tracked > required, "overpaid").when(tracked == required, "complete").when(tracked > 0, "partial").otherwise("pending")
    )


def remaining(required: Column, tracked: Column) -> Column:
    return F.greatest(F.lit(0.0), required - tracked)


def confidence_tier(score: Column) -> Column:
    return F.when(score >= 95, "verified").when(score >= 85, "high").when(score >= 70, "review").otherwise("low")


def split_by_gate(df: DataFrame, gate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a gate and the rejected rest; an unknown gate rejects."""
    passed = F.coalesce(gate, F.lit(False))
    return df.where(passed), df.where(~passed)


def grounded(value: Column, page: Column) -> Column:
    """Whether a value is borne out by its page: as text, without spaces, by a run of digits, or by 60 % of its longer words."""
    low_value, low_page = F.lower(F.trim(value)), F.lower(page)
    squeeze = lambda c: F.regexp_replace(c, r"[^a-z0-9]", "")
    digits = F.regexp_extract_all(low_value, F.lit(r"(\d{2,})"), F.lit(1))
    words = F.filter(F.split(low_value, r"[^a-z0-9]+"), lambda w: F.char_length(w) >= 4)
    found = F.size(F.filter(words, lambda w: F.contains(low_page, w)))
    return (low_value != "") & (
        F.contains(low_page, low_value)
        | ((squeeze(low_value) != "") & F.contains(squeeze(low_page), squeeze(low_value)))
        | F.exists(digits, lambda d: F.contains(squeeze(low_page), d))
        | ((F.size(words) > 0) & (found >= 0.6 * F.size(words)))
    )
