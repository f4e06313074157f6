"""Queries: operators applied to whole tables, each beside the SQL that gives the same rows where there is some."""

from quillon.plans import curation, extraction, lookups, mis, rulebook, scoring, sinks, streams, texts, validating
from quillon.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "curation", "extraction", "lookups", "mis", "rulebook", "scoring", "sinks", "streams", "texts", "validating"]
