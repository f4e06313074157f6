"""What is dear is worked out once a row: no filter of a plan holds it again."""

import re

import pytest

from quillon.plans import QUERIES


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["j08_alias_lookup", "j10_closest_label", "st08_parameters", "r03_page_sections", "a16_section_rollup"])
def test_filters_hold_nothing_dear(spark, sf, name):
    filters = [x for x in plan(spark, sf, name).splitlines() if re.match(r"[\s:+|-]*Filter ", x)]
    assert filters and not [x for x in filters if re.search("(?i)rlike|regexp|levenshtein|split", x)]


@pytest.mark.parametrize("name", ["r01_service_classification", "r02_tender_type"])
def test_text_is_made_normal_once(spark, sf, name):
    assert plan(spark, sf, name).count("regexp_replace") == 1
