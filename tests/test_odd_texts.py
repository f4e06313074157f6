"""Queries against their SQL on odd texts: letters with marks beside words, other line ends, ligatures, signs without weight."""

import duckdb
import pytest

from quillon.plans import ORACLE, QUERIES
from tests.test_queries import rows_of

TEXTS = [
    "Straße one", "Strasse two", "STRASSE three", "cœur un", "coeur deux", "Élan", "elan", "élan", "soft­ware x", "software y", "ΟΔΟΣ a", "οδοσ b", "Łódź", "lodz", "​zero", "zero",
    "épan pané gstà émaf pan gst. " * 3, "Opening Of Bids\r\nScope Of The Work\rGENERAL TERMS: \nSection\u000bIV\n", "x\rannexure a annexure b\u0085appendix c", "tender\u000bnotice technical\u000bbid",
    "ſcope of work, ſtatement of worK; ſimilar worKs", "emd epf é" * 5, "", None,
]


@pytest.mark.parametrize("name", ["l06_collated_groups", "r03_dossier_sections", "a16_dossier_rollup", "st18_page_headings"])
def test_odd_texts(spark, tmp_path, name):
    rows = [(k, t, ("a", "b")[k % 7 == 0]) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE[name])
    assert rows_of(got.columns, got.collect()) == rows_of([x[0] for x in want.description], want.fetchall())
