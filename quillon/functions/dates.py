"""Date expressions. The present moment is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def days_until(when: Column, as_of: Column) -> Column:
    """Whole days from ``as_of`` to a moment, rounded up; negative once past."""
    return F.ceil((F.unix_micros(when.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / F.lit(float(DAY))).cast("long")


def alert_priority(days: Column) -> Column:
    return F.when(days <= 7, "critical").when(days <= 15, "high").when(days <= 30, "medium").otherwise("low")


def expiry_level(days: Column, compat: bool = False) -> Column:
    """The tightest threshold reached; ``compat`` scans 30 days first, as the widest then always wins."""
    past = F.when(days < 0, "expired")
    steps = ((30, "30_days"), (15, "15_days"), (7, "7_days")) if compat else ((7, "7_days"), (15, "15_days"), (30, "30_days"))
    for limit, name in steps:
        past = past.when(days <= limit, name)
    return past


def fiscal_year_start(day: Column) -> Column:
    """The calendar year in which the April-to-March year of a day began."""
    return F.year(day) - (F.month(day) < 4).cast("int")


def fiscal_year_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def last_fiscal_years(as_of: Column, n: int) -> Column:
    """Labels of the ``n`` complete fiscal years before the one of ``as_of``, newest first."""
    now = fiscal_year_start(as_of)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: fiscal_year_label(now - i))


def countdown(deadline: Column, as_of: Column) -> Column:
    """Time left as ``Xd Yh``, ``Xh Ym`` or ``Ym``; Expired once past."""
    minutes = F.floor((F.unix_micros(deadline) - F.unix_micros(as_of)) / 60_000_000)
    d, h, m = F.floor(minutes / 1440), F.floor(minutes / 60) % 24, minutes % 60
    s = lambda c: c.cast("long").cast("string")
    return (
        F.when(minutes < 0, "Expired").when(d > 0, F.concat(s(d), F.lit("d "), s(h), F.lit("h")))
        .when(h > 0, F.concat(s(h), F.lit("h "), s(m), F.lit("m"))).otherwise(F.concat(s(m), F.lit("m")))
    )


def submission_level(deadline: Column, as_of: Column) -> Column:
    """The tightest alert level of a deadline."""
    hours = (F.unix_micros(deadline) - F.unix_micros(as_of)) / 3_600_000_000
    return F.when(hours < 0, "expired").when(hours <= 1, "1_hour").when(hours <= 6, "6_hours").when(hours <= 24, "24_hours").when(hours <= 72, "3_days").when(hours <= 168, "7_days")


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def normalize_date(raw: Column) -> Column:
    """struct<valid, value, reason>: ISO, day/month/year (swapped where only that can be) or day month-name year, as ISO.

    Two-digit years from 70 on are of the 1900s. Years lie in 1900 to 2100; impossible days are invalid.
    """
    text = F.trim(raw)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    dmy = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})$"
    named = r"(?i)^(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{2,4})$"
    part = lambda pattern, g: F.expr("cast(null as int)") if pattern is None else F.try_to_number(F.regexp_extract(text, pattern, g), F.lit("9999")).cast("int")
    month = F.lit(None).cast("int")
    for k, name in enumerate(MONTHS):
        month = F.when(F.lower(F.regexp_extract(text, named, 2)) == name, k + 1).otherwise(month)
    is_iso, is_dmy, is_named = text.rlike(iso), text.rlike(dmy), text.rlike(named)
    a, b = part(dmy, 1), part(dmy, 2)
    swap = (b > 12) & (a <= 12)
    y = F.when(is_iso, part(iso, 1)).when(is_dmy, part(dmy, 3)).when(is_named, part(named, 3))
    y = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    m = F.when(is_iso, part(iso, 2)).when(is_dmy, F.when(swap, a).otherwise(b)).when(is_named, month)
    d = F.when(is_iso, part(iso, 3)).when(is_dmy, F.when(swap, b).otherwise(a)).when(is_named, part(named, 1))
    text_date = F.format_string("%04d-%02d-%02d", y, m, d)
    real = F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), F.try_to_timestamp(text_date, F.lit("yyyy-MM-dd")).cast("date"))
    in_range = y.between(1900, 2100)
    reason = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(y.isNull() | m.isNull(), "unrecognised").when(~in_range, "year_out_of_range").when(real.isNull(), "impossible_date")
    ok = real.isNotNull() & in_range
    return F.struct(F.coalesce(ok, F.lit(False)).alias("valid"), F.when(ok, F.date_format(real, "yyyy-MM-dd")).alias("value"), reason.alias("reason"))


def duration_months(raw: Column) -> Column:
    """Years, months, weeks or days in a text, as months."""
    n = lambda unit: F.regexp_extract(raw, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}", 1)
    number = lambda unit: F.when(n(unit) != "", n(unit).cast("double"))
    return F.coalesce(number("year") * 12, number("month"), number("week") / 4, number("day") / 30)


def experience_years(raw: Column) -> Column:
    got = F.regexp_extract(raw, r"(?i)(\d+)\s*(?:year|yr)", 1)
    return F.when(got != "", got.cast("int")).otherwise(0)


def latest_date(text: Column) -> Column:
    """The latest day/month/year date that a text holds; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: normalize_date(x)["value"].cast("date")))


def expiry_check(day: Column, as_of: Column) -> Column:
    """Past: error; within 30 days: warning; else ok, also where no date is known."""
    days = F.datediff(day, as_of)
    return F.when(days < 0, "error").when(days <= 30, "warning").otherwise("ok")


def flexible_date(raw: Column) -> Column:
    """A certificate's date: day month-name year, else three numbers by slash, dash or dot, else ISO; null if it is none.

    Two-digit years are of this century. Three numbers are day, month and year; a second number above 12 with a first of up to 12 swaps
    them, so every reading is a real month. Days beyond the end of a month run over into the next one, as calendars of scripts have it.
    """
    text = F.trim(raw)
    named, numbers, iso = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", r"^(\d{1,4})[/\-.](\d{1,4})[/\-.](\d{1,4})$", r"^(\d{4})-(\d{2})-(\d{2})$"
    part = lambda pattern, g: F.regexp_extract(text, pattern, g).try_cast("int")
    month = F.lit(None).cast("int")
    for k, name in enumerate(MONTHS):
        month = F.when(F.lower(F.substring(F.regexp_extract(text, named, 2), 1, 3)) == name, k + 1).otherwise(month)
    run_over = lambda y, m, d: F.date_add(F.make_date(y, m, F.lit(1)), d - 1)
    day, second, year = part(numbers, 1), part(numbers, 2), part(numbers, 3)
    year = F.when(year < 100, year + 2000).otherwise(year)
    swapped = (second > 12) & (day <= 12)
    by_numbers = F.when(F.when(swapped, day).otherwise(second).between(1, 12) & (year >= 1), run_over(year, F.when(swapped, day).otherwise(second), F.when(swapped, second).otherwise(day)))
    return F.when(text.rlike(iso), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(named) & month.isNotNull(), run_over(part(named, 3), month, part(named, 1))).when(text.rlike(numbers), by_numbers)
