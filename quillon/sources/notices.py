"""Notices and candidates: texts and scored rows as views over the stored tables.

The stored tables have no tender notices, so each order gives one: a page of labelled lines whose amounts, dates
and wording follow from the order's columns. Lines of orders stand for extracted candidates of parameters. The views are
written as SQL expressions that Spark and other engines read alike, so queries and the SQL beside them see the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.domain import table


def _choose(index: str, values: list[str]) -> str:
    """One of several SQL expressions by an index, the last one for all that are left."""
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[:-1]))
    return f"CASE {index} {whens} ELSE {values[-1]} END"


_K, _P = "o_orderkey", "o_totalprice"
_DMY = "CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)"
_INT = "CAST(CAST(floor({0}) AS BIGINT) AS STRING)"

#: Label and value of each line of a notice.
FIELDS = {
    "Tender No": f"'T-' || CAST({_K} AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)",
    "Name of Work": _choose(f"{_K} % 8", [
        "'Security guard and watch and ward with CCTV'", "'Housekeeping, cleaning and sanitation'", "'Manpower: driver, helper and operator'",
        "'Supply of hardware and network software'", "'Civil works, road work and construction'", "'Vehicle hire and transport fleet, turnkey'",
        "'Consultancy and feasibility study'", "'General purposes'"]),
    "EMD Amount": _choose(f"{_K} % 4", [f"'Rs ' || {_INT.format(_P + ' / 50')}", f"{_INT.format(_P + ' / 100000')} || '.5 Lakh'", "'Nil'", f"'Rs. ' || {_INT.format(_P + ' / 50')} || '/-'"]),
    "Estimated Cost": _choose(f"{_K} % 3", [f"'Rs ' || {_INT.format(_P)}", f"{_INT.format(_P + ' / 10000')} || ' Lakh'", f"{_INT.format(_P + ' / 100000')} || '.25 Crore'"]),
    "Last Date": _choose(f"{_K} % 5", ["CAST(CAST(o_orderdate AS DATE) AS STRING)", _DMY, "'5 Mar ' || CAST(year(o_orderdate) AS STRING)", "'31/02/1997'", "'soon'"]),
    "Experience": f"CAST({_K} % 9 AS STRING) || ' years'",
    "Completion Period": _choose(f"{_K} % 4", ["'2 years'", "'18 months'", "'6 weeks'", "'90 days only'"]),
    "Turnover": f"'Rs ' || CAST({_K} % 13 AS STRING) || ' Crore'",
    "Contact": f"'officer' || CAST({_K} AS STRING) || '@example.org'",
    "Phone": _choose(f"{_K} % 3", [f"'+91 98765' || lpad(CAST({_K} % 100000 AS STRING), 5, '0')", f"'0' || CAST({_K} % 1000 AS STRING)", f"'58765' || lpad(CAST({_K} % 100000 AS STRING), 5, '1')"]),
    "Certificates": _choose(f"{_K} % 6", ["'ISO 9001, GST registration'", "'PAN and GST'", "'OEM authorized dealer certificate'", "'MSME Udyam certificate'", "''", "'none'"]),
}
_HEAD = _choose(f"{_K} % 3", ["'NOTICE INVITING TENDER'", "'INVITATION TO BID'", "'TENDER NOTICE'"])
TEXT = " || chr(10) || ".join([_HEAD, *[f"'{label}: ' || {value}" for label, value in FIELDS.items()], f"'Page ' || CAST({_K} % 30 + 1 AS STRING) || ' of 30'"])

_N = "(l_orderkey * 7 + l_linenumber * 3 + l_partkey)"
CANDIDATE = {
    "candidate_id": "l_orderkey * 10 + l_linenumber",
    "notice_id": "l_orderkey",
    "page": f"{_N} % 60 + 1",
    "parameter": _choose(f"{_N} % 5", ["'EMD Amount'", "'Tender Value'", "'Scope of Work'", "'Contact Officer'", "'Completion Period'"]),
    "value": _choose("l_linenumber % 3", ["''", f"CAST({_N} % 40 AS STRING)", "'as stated'"]),
    "confidence": f"{_N} % 101",
    "source": _choose(f"{_N} % 3", ["'AI'", "'RULE'", "'AI+RULE'"]),
    "method": _choose(f"{_N} % 6", ["'exact'", "'regex'", "'alias'", "'fuzzy'", "'ai_inferred'", "'unknown'"]),
    "section_match": _choose("l_suppkey % 3", ["'primary'", "'fallback'", "'none'"]),
    "alias_mapped": "l_partkey % 3 <> 0",
    "alias_score": "l_partkey % 101",
    "validation": _choose(f"{_N} % 4", ["'VALID'", "'REVIEW'", "'REJECT'", "CAST(NULL AS STRING)"]),
    "ai_confidence": f"CASE WHEN {_N} % 7 = 0 THEN NULL ELSE {_N} % 101 END",
    "correctness": _choose(f"{_N} % 3", ["'correct'", "'uncertain'", "'incorrect'"]),
    "type_match": "l_suppkey % 2 = 0",
}


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(notice_id, page_number, text)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notice_id"), F.expr(f"{_K} % 30 + 1").alias("page_number"), F.expr(TEXT).alias("text"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(notice_id, and a column of raw text for each label of a notice)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notice_id"), *[F.expr(v).alias(k.lower().replace(" ", "_")) for k, v in FIELDS.items()])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(v).alias(k) for k, v in CANDIDATE.items()])


#: The same views for SQL, to stand in a WITH clause.
SQL = {
    "notices": f"notices AS (SELECT o_orderkey AS notice_id, {_K} % 30 + 1 AS page_number, {TEXT} AS text FROM orders)",
    "fields": "fields AS (SELECT o_orderkey AS notice_id, " + ", ".join(f"{v} AS {k.lower().replace(' ', '_')}" for k, v in FIELDS.items()) + " FROM orders)",
    "candidates": "candidates AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CANDIDATE.items()) + " FROM lineitem)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
