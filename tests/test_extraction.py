"""Extraction rules on worked pages, and the family across lines against Python's own look-ahead."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import locate, mapping, parameters, tables
from quillon.plans import QUERIES


def _pages(spark, *texts):
    return spark.createDataFrame([(i // 100, i % 100 + 1, t) for i, t in texts], "doc_id long, page int, text string")


def _one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_places_count_characters(spark):
    assert _one(spark, lambda t: locate.places(t, "ab"), "abab é ab") == [0, 2, 7]
    assert _one(spark, lambda t: locate.places(t, "x"), "") == [] and _one(spark, lambda t: locate.places(t, "x"), None) == []


def test_deposits_follow_label_page_and_percentage(spark):
    got = locate.located_deposits(_pages(
        spark,
        (0, "EMD Rs. 1,00,000"), (1, "EMD Amount: Rs. 2,00,000"), (2, "EMD Amount: Rs. 3,00,000"),  # the stronger label, then the earlier page
        (100, "Estimated Cost Rs. 1,00,00,000 and EMD @ 2%"), (101, "EMD Amount Rs. 9,000"), (102, "Earnest Money Rs. 2,04,000"),  # two percent of the cost, almost
        (200, "EMD Amount Rs. 50,000 as in the balance sheet"), (201, None),  # the context rejects it
        (300, "Tender Value Rs. 1,00,000"), (301, "EMD Amount Rs. 25,000"),  # above a fifth of the value
        (400, "BEMD Rs. 10,000"), (401, "EMDs Rs. 10,000"), (402, "EMD Rs. 999"),  # inside words, too few digits
        (500, "EMD Amount " + "x" * 110 + " Rs. 10,000"), (501, "Bid Security " + "x" * 90 + " Rs. 20,000"),  # too far behind the label
        (600, "Estimated Cost Rs. 1,00,00,000 EMD @ 2%"), (625, "EMD Rs. 2,00,000"),  # a bare label late on: rejected, but it is the percentage
    )).collect()
    assert {r.doc_id: (r.amount, r.page, r.label, r.confidence, r.rule) for r in got} == {
        0: ("Rs. 2,00,000", 2, "EMD Amount", 100, "explicit_statement"),
        1: ("Rs. 2,04,000", 3, "Earnest Money", 100, "percentage_validated"),
        5: ("Rs. 20,000", 2, "Bid Security", 100, "explicit_statement"),
        6: ("Rs. 2,00,000", 26, "EMD", 100, "percentage_rule"),
    }


def test_values_follow_the_deposit(spark):
    got = locate.located_values(_pages(
        spark,
        (0, "Estimated Cost Rs. 5,00,000"), (1, "Project Cost Rs. 1,01,00,000"), (2, "EMD Amount Rs. 2,00,000 and EMD @ 2%"),
        (100, "Contract Value Rs. 7,00,000"), (109, "Tender Value Rs. 8,00,000"),
        (200, "Estimated Cost Rs. 5,00,000 of the previous work order"),
    )).collect()
    assert {r.doc_id: (r.amount, r.label, r.confidence, r.rule) for r in got} == {0: ("Rs. 1,01,00,000", "Project Cost", 100, "emd_cross_validated"), 1: ("Rs. 8,00,000", "Tender Value", 92, "explicit_statement")}


def test_answers_and_amounts_near_keywords(spark):
    yes_no = lambda t: _one(spark, lambda c: locate.answer(c, ("reverse auction",)), t)
    assert [yes_no(t) for t in ("Reverse Auction: not required", "reverse auction is required", "Reverse auction\nyes", "reverse auction mandatory", "reverse auction " + "x" * 61 + " yes", "none")] == ["No", "Yes", "", "Yes", "", ""]
    near = lambda t: _one(spark, lambda c: locate.near_amount(c, ("emd", "bid security")), t)
    assert [near(t) for t in ("EMD of about Rs. 1,00,000", "EMD " + "x" * 41 + " 5", "emd nil; bid security: 2.5 Cr", "")] == ["1,00,000", "", "2.5 Cr", ""]  # what leads to the first digit belongs to the distance
    items = _one(spark, lambda c: locate.listed(c, ("documents required",)), "X. Documents required\n1. PAN copy 2. GST copy\npage 3\nabc\n(a) ISO • Bond - Deed\nOne more\nAnd more\nSeven")
    assert items == ["Documents required", "PAN copy", "GST copy", "Bond", "Deed", "One more"]


def _anywhere(text):
    """The family that reads across lines, with Python's look-ahead."""
    label = r"[A-Za-z][A-Za-z0-9\s/().&,'°#%\-]"
    found = re.finditer(rf"({label}{{1,90}}?)\s*[:=–—\-]\s*([^:\n]{{1,400}}?)(?=\s+{label}{{2,35}}?\s*[:=–—\-]|\n\n|\Z)", text, re.I | re.A)
    out = []
    for m in found:
        cut = re.search(rf"\s+(?={label}{{2,65}}?\s*[:=–—\-]\s*)", m[2], re.I | re.A)
        out.append((m[1], (m[2][: cut.start()] if cut and cut.start() else m[2]).strip()))
    return out


@pytest.mark.parametrize("text", [
    "Bid No: 12 Place: Pune Mode = Online", "Contact Officer - The Engineer\n12 - 15 May", "A: b\nName of work: road\nrepair Cost - 5\n\nEnd: x", "no labels here", "a:b", "x = 1 - 2 y : z w = v", "Rate: 5\nrate : 5\n\nDate: 1",
])
def test_labels_across_lines(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(parameters.anywhere_matches(F.col("t"))).first()[0]
    assert [(r.name, r.value) for r in got or []] == _anywhere(text)


def test_every_family_occurs_in_the_dossiers(spark, sf):
    found = {r.family for r in QUERIES["st08_all_families"](spark, sf).select("family").distinct().collect()}
    assert found >= {"chained", "colon", "tabs", "numbered", "spaced", "dots", "pipe"}
    # what a dash says, the chained family has seen before, and so has the one across lines most of what it reads
    pages = _pages(spark, (0, "Contact - A\nBank\tSBI\tBranch\tPune\n12) Rate: 5\n| Sr | No |\nIndex: 4\nRs: 5"))
    one = {f: [(r.name, r.value) for r in parameters.page_parameters(pages, (f,)).collect()] for f in parameters.FAMILIES}
    assert one["dash"] == [("Contact", "A")] and sorted(one["tabs"]) == [("Bank", "SBI"), ("Branch", "Pune")] and ("Rate", "5") in one["numbered"] and one["pipe"] == []


def test_names_meet_aliases_at_boundaries(spark):
    aliases = mapping.registry(spark, [("Short", ["no"]), ("Long", ["bid reference no", "bid"]), ("Mid", ["tender no"])])
    names = spark.createDataFrame([("bid reference no",), ("my tender no",), ("tender now",), ("no: x",), ("e-bid y",), ("forbid",), ("",), (None,)], "name string")
    got = {r.name: r.target for r in mapping.mapped_names(names, aliases).collect()}
    assert got == {"bid reference no": "Long", "my tender no": "Mid", "no: x": "Short", "e-bid y": "Long"}
    start = {r.name: (r.target, r.way) for r in mapping.mapped_names(names, aliases, anywhere=False, shortest=3).collect()}
    assert start == {"bid reference no": ("Long", 1)}
    exact = spark.createDataFrame([("my tender no", "Mine")], "name string, target string")
    assert {r.name: (r.target, r.way) for r in mapping.mapped_names(names, aliases, exact).where("way = 0").collect()} == {"my tender no": ("Mine", 0)}


def test_tables_have_titles_columns_and_filled_rows(spark):
    text = "ANNEXURE A\nSr No\tName\tValue\n1\tEMD\t500\n2\tFee\n\nplain\n| one | two |\nshort\na  b\nc  d  e\n" + "x" * 41 + "  y\nz  w"
    got = tables.page_tables(_pages(spark, (0, text))).orderBy("spot", "row").collect()
    assert [(r.spot, r.title, r.columns, r.cells) for r in got] == [
        (1, "ANNEXURE A", ["Sr No", "Name", "Value"], ["1", "EMD", "500"]), (1, "ANNEXURE A", ["Sr No", "Name", "Value"], ["2", "Fee", ""]),
        (8, "", ["a", "b"], ["c", "d", "e"]), (8, "", ["a", "b"], ["x" * 41, "y", ""]), (8, "", ["a", "b"], ["z", "w", ""]),
    ]


def test_odd_pages(spark):
    odd = _pages(spark, (0, None), (1, ""), (2, "\n\n"), (3, ":" * 50), (4, "é" * 5000), (5, "|" * 30), (6, "EMD"))
    assert locate.located_deposits(odd).count() == 0 and locate.located_values(odd).count() == 0
    assert parameters.page_parameters(odd).count() == 0 and tables.page_tables(odd).count() == 0
    empty = odd.limit(0)
    assert locate.located_deposits(empty).count() == 0 and parameters.page_parameters(empty).count() == 0 and tables.field_candidates(empty, [("f", ("A",), (), (), (), 9)]).count() == 0
