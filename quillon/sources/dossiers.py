"""Dossiers: the pages of long documents, prose with statements, lists and tables of tenders in it.

The stored documents are prose without any labels. A view cuts each of them into pages of 3000 characters and puts
statements into the prose of each page: which ones, and how far apart they stand, follows from the document's and the page's number.
The view is SQL that Spark and other engines read alike, so both see the same texts, and must find the statements in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.notices import _choose

PAGE_CHARS = 3000
_K = "(doc_id * 7 + part * 5)"


def _number(of: str) -> str:
    return f"CAST({of} AS STRING)"


def _two(of: str) -> str:
    return f"lpad(CAST(({of}) % 100 AS STRING), 2, '0')"


#: Amounts grouped as 12,34,000; the large one is about fifty times the small one.
SMALL = f"{_number(f'1 + {_K} % 9')} || ',' || {_two(_K)} || ',000'"
LARGE = f"{_number(f'50 + ({_K} % 9) * 50')} || ',' || {_two(_K + ' * 3')} || ',500'"
CRORE = f"{_number(f'1 + {_K} % 4')} || ',' || {_two(_K)} || ',' || {_two(_K + ' * 3')} || ',000'"
_ID = _number("doc_id")

#: Statements of amounts, numbers and names.
STATEMENTS = [
    f"'EMD Amount: Rs. ' || {SMALL}",
    f"'Earnest Money Deposit of INR ' || {SMALL} || ' only'",
    f"'Bid Security (INR ' || {SMALL} || ') and EMD @ 2% of cost'",
    f"'The EMD @ 2% of the estimate, that is Rs. ' || {SMALL}",
    f"'Security Deposit Rs. ' || {SMALL} || ' as per balance sheet'",
    "'EMD: Nil'",
    f"'Earnest Money shall be paid by draft before the last day of sale, and what has to be paid is an amount of just about Rs ' || {SMALL}",
    f"'Earnest Money shall be paid by draft and is an amount of Rs ' || {SMALL}",
    f"'Amount of EMD Rs. ' || {SMALL} || ', annual turnover Rs. ' || {CRORE}",
    f"'BEMD Rs. ' || {SMALL}",
    f"'EMDs Rs. ' || {SMALL}",
    f"'Estimated Cost of Work: Rs. ' || {CRORE}",
    f"'Estimated Cost Rs ' || {LARGE} || ' EMD Rs. ' || {SMALL}",
    f"'Tender Value - Rs. ' || {LARGE}",
    f"'Contract Value: INR ' || {CRORE} || ' by work order value'",
    f"'Approximate Cost  Rs.' || {LARGE} || ' EMD @ 2%'",
    "'Project Cost 12345'",
    f"'Tender No. T/' || {_ID} || '/2024 Completion time: 18 months from the date of award'",
    f"'NIT No: ' || {_ID} || '-A'",
    f"'Name of work: Repair of road ' || {_ID}",
    f"'Issued by: Public Works Department ' || {_ID}",
    "'Reverse Auction: not required'",
    "'Reverse auction is mandatory'",
    "'MAF from the maker is required'",
    "'manufacturer authorization form, not applicable'",
    f"'Performance Guarantee of 5% or ' || {LARGE}",
    "'PBG as agreed'",
    "'Bid submission up to: 12/05/2024 15:00'",
    "'Last date for queries: 5 May 2024'",
    "'Pre-bid meeting at Pune: 2 May 2024'",
    f"'Estimated value ' || {_number(f'1 + {_K} % 40')} || '.5 Crore'",
    f"'EMD ' || {_number(f'1 + {_K} % 40')} || ' lakhs'",
    "'GSTIN: 27ABCDE1234F1Z5'",
    "'GST: extra as applicable'",
    "'PAN: ABCDE 1234 F'",
    "'PAN: as shall be given'",
    "'EMD percentage: 2 %'",
    "'PBG percentage: five of the value'",
    "'Experience requirement: three similar works completed'",
    "'Similar work: INDEX'",
    "'Scope of work: supply of guards and maintenance of the site, including tools'",
    "'Scope of work: services'",
    "'Last date: Technical'",
    "'Last date: 31/12/2024'",
    "'Bid end date: 45/13/2024'",
    "'Submission deadline: 3.1.2'",
    "'Publishing date: March'",
    "'Bid validity: 90('",
    "'Warranty period: 2 years from delivery'",
    "'Contract period: 36'",
    "'Tender value: annual turnover of 5 crore'",
    "'Project cost: Rs 5 crore'",
    "'Bank guarantee: shall be given in the form that the annexure states'",
    "'Security deposit: ANNEXURE'",
    "'Tender fee: Rs 500'",
    "'Document fee: none'",
    "''",
]
#: Blocks of lines: lists and tables, and label/value lines of every shape.
BLOCKS = [
    "'Documents required' || chr(10) || '1. PAN copy 2. GST copy' || chr(10) || '(a) ISO certificate' || chr(10) || 'Page 3 of 9' || chr(10) || 'Enclosures as listed'",
    "'ANNEXURE ONE' || chr(10) || 'Particulars | Amount' || chr(10) || 'EMD Amount | ' || " + SMALL + " || chr(10) || 'Tender Fee | 500' || chr(10) || 'Completion Period | 12 months | extended'",
    "'Sr No' || chr(9) || 'Description' || chr(9) || 'Value' || chr(10) || '1' || chr(9) || 'Earnest Money' || chr(9) || " + SMALL + " || chr(10) || '2' || chr(9) || 'Period of completion' || chr(9) || '90 days'",
    "'Schedule of Dates' || chr(10) || 'Opening of bids    5 May 2024' || chr(10) || 'Contract Period    24 months' || chr(10) || 'Rate    5 per cent    yearly'",
    "'Bid No: ' || " + _ID + " || ' Place: Pune Mode = Online'",
    "'1) Validity of bid: 90 days' || chr(10) || 'iv. Currency = INR' || chr(10) || '2. Index: none'",
    "'Contact Officer - The Engineer' || chr(10) || '12 - 15 May'",
    "'Delivery' || chr(9) || 'Six weeks' || chr(10) || 'Bank' || chr(9) || 'SBI' || chr(9) || 'Branch' || chr(9) || 'Pune'",
    "'Payment terms ...... within 30 days' || chr(10) || 'Warranty....... 2 years'",
    "'| Inspection | at site |' || chr(10) || 'Sr | No' || chr(10) || 'Insurance | by bidder'",
    "'Liquidated damages    one per cent a week' || chr(10) || 'Place of work  Pune Depot: North'",
    "'1234 : 5678' || chr(10) || 'Rate: ===' || chr(10) || 'Index: 4' || chr(10) || 'Rate: ===' || chr(10) || 'Rate: 5' || chr(10) || 'rate : 5'",
    "'Introduction: general' || chr(10) || 'Clause 4.2: as below' || chr(10) || 'Annexure B: yes' || chr(10) || 'Contents: 5 pages' || chr(10) || 'Email: office@example.org' || chr(10) || 'Office: +91 98765 43210' || chr(10) || 'Mail to: x@y.example'",
    "'Page 4: of nine' || chr(10) || 'Header: text' || chr(10) || 'Printed on: 5 May' || chr(10) || 'Section IV: text' || chr(10) || 'Chapter 2.: text' || chr(10) || 'Para 2.1: text' || chr(10) || 'Website address: none' || chr(10) || 'Mobile phone of guard: none'",
    "'Refer: to the office' || chr(10) || 'Remarks: see annexure C' || chr(10) || 'Rates: one two ONE two' || chr(10) || 'Code: abcabc' || chr(10) || 'Place: place' || chr(10) || 'Contact us: at the desk' || chr(10) || 'Fax no.: none' || chr(10) || 'Unit: 5'",
    "'SECTION 4 OF THE NOTICE' || chr(10) || 'GENERAL CONDITIONS:' || chr(10) || 'BIDDERS SHALL SIGN' || chr(10) || '3. Opening Of Bids' || chr(10) || 'Scope Of The Work'",
    "'Performance guarantee: Rs. ' || " + SMALL + " || chr(10) || 'EMD Amount: Rs. ' || " + SMALL,
    "'No labels here'",
]
_PICK_A, _PICK_B = f"(({_K} + doc_id) % {len(STATEMENTS)})", f"(({_K} * 3 + part + 11) % {len(STATEMENTS)})"
_CUT, _GAP = f"CAST({_K} % 300 AS INT)", f"CAST(({_K} * 11) % 260 AS INT)"
TEXT = (
    f"substr(body, 1, {_CUT}) || chr(10) || {_choose(_PICK_A, STATEMENTS)} || chr(10) || substr(body, {_CUT} + 1, {_GAP}) || chr(10) || {_choose(_PICK_B, STATEMENTS)} || chr(10)"
    f" || {_choose(f'(({_K} + part) % {len(BLOCKS)})', BLOCKS)} || chr(10) || substr(body, {_CUT} + {_GAP} + 1, {PAGE_CHARS})"
)
_PAGE = "CAST(part * 4 + doc_id % 4 + 1 AS INT)"
_PARTS = f"CAST(floor(greatest(length(coalesce(text, '')) - 1, 0) / {PAGE_CHARS}.0) AS INT)"


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): every document, a null one as one empty page of prose; page numbers have gaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = docs.selectExpr("doc_id", "coalesce(text, '') AS text", f"explode(sequence(0, {_PARTS})) AS part")
    return parts.selectExpr("doc_id", "part", f"substr(text, part * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS body").selectExpr("doc_id", f"{_PAGE} AS page", f"{TEXT} AS text")


#: The same view for SQL, to stand in a WITH clause.
SQL = (
    f"dossier_parts AS (SELECT doc_id, coalesce(text, '') AS text, unnest(generate_series(0, {_PARTS})) AS part FROM documents), "
    f"dossiers AS (SELECT doc_id, {_PAGE} AS page, {TEXT} AS text FROM (SELECT doc_id, part, substr(text, part * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS body FROM dossier_parts) AS p)"
)
