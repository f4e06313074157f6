"""Patterns that cost much are worked out once, and what they find stays the same."""

import random

from pyspark.sql import functions as F

from quillon.operators import parameters
from quillon.plans import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_searched_once_for_labels_across_lines(spark):
    pages = spark.createDataFrame([(1, 1, "A: b")], "doc_id long, page int, text string")
    assert _plan(parameters.page_parameters(pages)).count(r"|\n\n|$)") == 1


def test_matches_are_taken_apart_as_the_page_was(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "Bc", ":", "-", "=", " ", " ", "\n", "\n\n", "\t", "1", "é", "–", "d e f"]) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    words = ["Road", "works of the", "-", ":", "; ", "é", ",", " ", "\n", "long prose without any marks in it at all " * 3, " " * 99, "Cost: 5", "a - b", "\n\n"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = [F.regexp_extract_all("t", F.lit(parameters.ANYWHERE), F.lit(g)) for g in (1, 2)]
    rows = rows.select("t", *[x.alias(n) for x, n in zip(both, ("names", "values"))]).cache()
    want = F.transform("names", lambda n, i: F.struct(n.alias("name"), parameters.before_next_label(F.element_at("values", i + 1)).alias("value")))
    got = F.transform(F.coalesce(parameters.anywhere_matches(F.col("t")), F.array()), lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value")))
    said = rows.select((got == want).alias("same"), F.size(want).alias("n")).agg(F.min("same"), F.sum("n")).first()
    assert said[0] and said[1] > 1000


def test_checklists_are_dealt_to_tasks_before_they_unfold(spark, sf):
    plan = _plan(QUERIES["r27_tender_checklists"](spark, sf))
    assert "RepartitionByExpression [tender" in plan and plan.index("Join Cross") < plan.index("RepartitionByExpression")


def test_lines_are_judged_once(spark, sf):
    plan = _plan(QUERIES["r14_five_layers"](spark, sf))
    assert plan.count("posexplode(") == 1 and plan.count("Join") == 0


def test_contracts_are_summed_up_once(spark, sf):
    assert _plan(QUERIES["al02_rule_alerts"](spark, sf)).count("Aggregate") == 1
