"""Amounts of money in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(raw: Column) -> Column:
    """The first number of a text, with Indian grouping and crore or lakh as words of their own; null without one."""
    number = F.regexp_extract(raw, r"(\d[\d,]*(?:\.\d+)?|\.\d+)", 1)
    value = F.when(number != "", F.regexp_replace(number, ",", "").cast("double"))
    return value * F.when(raw.rlike(r"(?i)\d\s*(crores?|cr)\b"), 1e7).when(raw.rlike(r"(?i)\d\s*(lakhs?|lacs?|l)\b"), 1e5).otherwise(1.0)


def parse_amount_compat(raw: Column) -> Column:
    """As older data was parsed: all but digits and dots go first, so the dot of "Rs." counts, and units match inside words."""
    kept = F.regexp_extract(F.regexp_replace(raw, r"[^\d.]", ""), r"^(\d*\.?\d+|\d+)", 1)
    value = F.when(kept != "", kept.cast("double"))
    return value * F.when(raw.rlike("(?i)cr"), 1e7).when(raw.rlike("(?i)lakh|lac"), 1e5).otherwise(1.0)


def digits_amount(raw: Column) -> Column:
    """The digits of an amount as a number; valid from four digits on, in texts of up to 60 characters."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"\.\d{1,2}\b", ""), r"\D", "")
    return F.when((F.char_length(raw) <= 60) & F.char_length(digits).between(4, 15), digits.cast("double"))


def within_percent(actual: Column, expected: Column, percent: float = 5.0) -> Column:
    return F.when(expected != 0, F.abs(actual - expected) / F.abs(expected) * 100 <= percent).otherwise(actual == expected)


def sane_deposit(deposit: Column, value: Column) -> Column:
    """A deposit may be a fifth of the tender's value at most, where that is known."""
    return value.isNull() | (value <= 0) | (deposit <= 0.2 * value)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x + 0.5)))


def display(amount: Column) -> Column:
    """Crores from ten million on, lakhs from a hundred thousand on, else the amount itself."""
    return (
        F.when(amount >= 1e7, F.format_string("%.2f Cr", amount / 1e7)).when(amount >= 1e5, F.format_string("%.2f L", amount / 1e5))
        .otherwise(F.format_string("%.2f", amount))
    )
