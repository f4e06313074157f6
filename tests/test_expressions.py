"""Worked cases of the scalar expressions and of the document and ranking operators."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, money, text
from quillon.operators import aggregates, documents, filters, joins, labels, ranking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, right, compat", [
    ("Rs 33,59,315", 3359315, 3359315), ("Rs. 33,59,315", 3359315, 0.3359315), ("Rs. 2.5 Crore", 25e6, 2e6), ("12 Lakh", 12e5, 12e5), ("5 at place", 5, 5e5), ("none", None, None),
])
def test_amounts(spark, raw, right, compat):
    assert one(spark, money.parse_amount(F.lit(raw))) == (None if right is None else pytest.approx(right))
    if "place" not in raw:
        assert one(spark, money.parse_amount_compat(F.lit(raw))) == (None if compat is None else pytest.approx(compat))


@pytest.mark.parametrize("raw, want", [("31/12/2025", "2025-12-31"), ("12/31/2025", "2025-12-31"), ("1 Jan 26", "2026-01-01"), ("31/02/2025", None), ("", None), ("1 Jan 75", "1975-01-01")])
def test_dates(spark, raw, want):
    got = one(spark, dates.normalize_date(F.lit(raw)))
    assert (got.value, got.valid) == (want, want is not None)


@pytest.mark.parametrize("raw, want", [("2 years", 24), ("18 months", 18), ("6 weeks", 1.5), ("90 days", 3)])
def test_durations(spark, raw, want):
    assert one(spark, dates.duration_months(F.lit(raw))) == want


def test_days_and_fiscal_years(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, dates.days_until(ts("2024-01-02"), ts("2024-01-01 01:00:00"))) == 1
    assert [one(spark, dates.fiscal_year_start(F.lit(d).cast("date"))) for d in ("2026-03-31", "2026-04-01")] == [2025, 2026]
    assert [one(spark, dates.expiry_level(F.lit(5), compat)) for compat in (False, True)] == ["7_days", "30_days"]
    assert [one(spark, dates.alert_priority(F.lit(d))) for d in (-1, 7, 8, 15, 16, 30, 31)] == ["critical", "critical", "high", "high", "medium", "medium", "low"]
    assert one(spark, dates.experience_years(F.lit("minimum 3 years"))) == 3


def test_statuses(spark):
    got = [one(spark, filters.requirement_status(F.lit(float(r)), F.lit(float(t)))) for r, t in ((0, 0), (0, 5), (10, 0), (10, 4), (10, 10), (10, 12))]
    assert got == ["not_required", "complete", "pending", "partial", "complete", "overpaid"]
    assert [one(spark, filters.confidence_tier(F.lit(s))) for s in (95, 94, 85, 84, 70, 69)] == ["verified", "high", "high", "review", "review", "low"]
    assert [one(spark, filters.expiry_status(F.lit(d), F.lit("x"))) for d in (-1, 0, 30, 31)] == ["Expired", "Expiring Soon", "Expiring Soon", "Active"]


def test_text(spark):
    assert one(spark, text.alias_key(F.lit("E.M.D. (Amount):"))) == "e m d amount"
    assert [text.keyword_weight(k) for k in ("a", "a b", "a b c")] == [2, 3, 5]
    got = one(spark, text.label_values(F.lit("Name of Work:\nProviding Manpower\nEMD: Rs. 33,59,315")))
    assert [(r.label, r.value) for r in got] == [("Name of Work", "Providing Manpower"), ("EMD", "Rs. 33,59,315")]
    assert one(spark, text.twice_the_same(F.lit("a b a b"))) and not one(spark, text.twice_the_same(F.lit("a b c")))


def test_ranking_has_one_winner(spark):
    rows = spark.createDataFrame([("k", 80, 3), ("k", 80, 1), ("k", 70, 1)], "key string, score int, page int")
    got = ranking.winners_and_losers(rows, ["key"], [F.col("score").desc(), F.col("page")]).collect()
    assert [(r.score, r.page) for r in got if r.rank_winner] == [(80, 1)] and len(got) == 3
    pages = spark.createDataFrame([("d", p, f"t{p}") for p in range(1, 13)], "doc string, page int, text string")
    assert sorted(r.page_numbers for r in ranking.chunked(pages, "doc", "page", "text", 5).collect()) == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12]]


def test_version_difference(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v int")
    assert tuple(joins.difference(old, new, "k", "v").first()) == (1, 0, 1)


def test_scan_quality_and_percent(spark):
    pages = spark.createDataFrame([("d", 2000), ("d", 0)], "doc string, char_count int")
    got = documents.scan_quality(pages, "doc").first()
    assert (got.avg_chars, got.coverage, got.score) == (1000, 0.5, 50)
    assert [one(spark, aggregates.percent(F.lit(a), F.lit(b))) for a, b in ((1, 3), (0, 0))] == [33.33, 0.0]


def test_rolling_hash(spark):
    for s in ("", "a", "T-12/1997", "x" * 60):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        n, want = abs(h), ""
        while n:
            n, digit = divmod(n, 36)
            want = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + want
        assert one(spark, text.rolling_hash36(F.lit(s))) == (want or "0")[:6]


def test_aliases_and_recovery(spark):
    registry = (("Earnest Money", 9, ("EMD",), ("(?i)\\bdeposit\\b",), ()), ("Period", 5, ("Completion Period", "EMD"), (), ("completion",)))
    said = ("E.M.D", "emd:", "Earnest Money", "the deposit", "period of completion", "nothing")
    found = labels.resolved_labels(spark.createDataFrame([(x,) for x in said], "label string"), labels.registry_tables(spark, registry))
    assert {r.label: (r.standard, r.score, r.method) for r in found.collect()} == {
        "emd:": ("Earnest Money", 95, "exact_alias"), "Earnest Money": ("Earnest Money", 99, "exact_canonical"), "the deposit": ("Earnest Money", 90, "pattern"), "period of completion": ("Period", 85, "semantic")}
    back = one(spark, text.recovered(F.lit("Bid End: 1 May\nx"), [r"End date (\d+)"], ["Bid End"]))
    assert (back.value, back.confidence) == ("1 May", 0.80)
    assert one(spark, text.deduped(F.array(F.lit("Cement"), F.lit("cement bags"), F.lit("12"), F.lit("Steel")))) == ["cement bags", "Steel"]
