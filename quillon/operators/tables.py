"""Tables in the text of pages as a grid of cells, and candidates of fields from tables, labels and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.locate import low

#: What makes a line one of a table, heads a table, and names it above; scores of a candidate by how it was found.
TABLE_LINE = r"\|[^\n]+\||\S\s{2,}\S|\t"
HEAD = r"(?i)^(?:sl\.?\s*no|sr\.?\s*no|particulars|description|details|amount|value|remarks)"
TITLE_WORD, TITLE = r"(?i)annexure|schedule|table|form", r"^[A-Z0-9][A-Za-z0-9\s\-–:()]+$"
COLON_CELLS = r"^([^\n]{2,55}?)\s*[:–-]\s*([^\n]+)$"
PATTERN_SCORE, LABEL_SCORE, SYNONYM_SCORE, CELL_SCORE, TITLED, COLUMN_SCORE, HINT_SCORE = 10, 7, 6, 12, 2, 11, 2
LABEL_REACH, LOOK_BACK = 60, 4


def cells(line: Column) -> Column:
    """The columns of a trimmed line: by pipes, else tabs, else two spaces, else a colon; else the whole line."""
    kept = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    spaced = kept(F.split(line, r"\s{2,}"))
    name = F.regexp_extract(line, COLON_CELLS, 1)
    by_colon = F.when(name != "", F.array(F.trim(name), F.trim(F.regexp_extract(line, COLON_CELLS, 2)))).otherwise(F.array(line))
    return F.when(F.contains(line, F.lit("|")), kept(F.split(line, r"\|"))).when(F.contains(line, F.lit("\t")), kept(F.split(line, "\t"))).when(F.size(spaced) >= 2, spaced).otherwise(by_colon)


def _titles(line: Column) -> Column:
    fits = F.char_length(line).between(6, 120) & ~line.rlike(TABLE_LINE)
    return F.when(fits & (line.rlike(TITLE_WORD) | line.rlike(TITLE)), line)


def page_tables(pages: DataFrame) -> DataFrame:
    """(doc_id, page, spot, title, columns, row, cells): the data rows of every table of two lines or more; ``spot`` is its first line.

    Neighbouring table lines are one table. Its first line names the columns if it looks like a head or has short cells only.
    A title is looked for in the four lines above. Rows with fewer cells are filled up.
    """
    said = F.trim(F.col("said"))
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "said")).withColumn("said", said)
    # one window over a page's lines, in their order: a page is bounded
    page = Window.partitionBy("doc_id", "page").orderBy("line")
    inside = (F.char_length("said") >= 4) & F.col("said").rlike(TABLE_LINE)
    above = F.coalesce(*[_titles(F.lag("said", k).over(page)) for k in range(1, LOOK_BACK + 1)])
    lines = lines.withColumn("inside", inside).withColumns({"title": above, "island": F.sum((~F.col("inside")).cast("int")).over(page)})
    rows = lines.where("inside").select("doc_id", "page", "island", F.struct("line", cells(F.col("said")).alias("cells"), F.coalesce("title", F.lit("")).alias("title"), F.col("said").rlike(HEAD).alias("head")).alias("r"))
    # a table lies within a page, so its rows fit in one array
    blocks = rows.groupBy("doc_id", "page", "island").agg(F.array_sort(F.collect_list("r")).alias("rows")).where("size(rows) >= 2")
    first = F.col("rows")[0]
    names = (F.size(first["cells"]) >= 2) & (F.array_join(first["cells"], " ").rlike(HEAD) | F.forall(first["cells"], lambda x: F.char_length(x) < 40))
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    columns = F.when(names, first["cells"]).when(width == 2, F.array(F.lit("Parameter"), F.lit("Value"))).otherwise(F.transform(first["cells"], lambda _, i: F.concat(F.lit("Col "), (i + 1).cast("string"))))
    title = F.when(first["title"] != "", first["title"]).when(first["head"], "Data Table").otherwise("")
    data = F.when(names, F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))
    out = blocks.select("doc_id", "page", first["line"].alias("spot"), title.alias("title"), columns.alias("columns"), width.alias("width"), F.posexplode(data).alias("row", "r"))
    filled = F.concat(F.col("r.cells"), F.array_repeat(F.lit(""), F.col("width") - F.size("r.cells")))
    return out.select("doc_id", "page", "spot", "title", "columns", "row", filled.alias("cells"))


def _clean(value: Column, longest: int) -> Column:
    return F.substr(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(1), F.lit(longest))


def _column_with(label: str) -> Column:
    """The first column whose name holds a label, from 1; 0 without one."""
    return F.array_position(F.transform("columns", lambda x: F.contains(F.lower(x), F.lit(label.lower()))), F.lit(True)).cast("int")


def field_candidates(pages: DataFrame, fields: list[tuple]) -> DataFrame:
    """(doc_id, page, field, way, value, score) of pages and fields (name, labels, synonyms, patterns, hints, longest value).

    Ways are ``pattern`` (10), ``label`` (7, other labels 6), ``cell`` (12, with a title 14) and ``column`` (11); each hint that a page
    holds adds 2. Every match counts, so equal candidates may repeat. Values have two characters or more.
    """
    text, found = F.col("text"), []
    for name, labels, synonyms, patterns, hints, longest in fields:
        bonus = sum((F.when(F.contains(low(text), F.lit(h.lower())), HINT_SCORE).otherwise(0) for h in hints), F.lit(0))

        def made(values: Column, way: str, score: int, n=name, m=longest, b=bonus) -> Column:
            return F.transform(values, lambda v: F.struct(F.lit(n).alias("field"), F.lit(way).alias("way"), _clean(v, m).alias("value"), (F.lit(score) + b).alias("score")))

        found += [made(F.regexp_extract_all(text, F.lit(p), F.lit(1)), "pattern", PATTERN_SCORE) for p in patterns]
        found += [made(F.regexp_extract_all(text, F.lit(rf"(?i){label}[^:\n]{{0,{LABEL_REACH}}}[:\s]+([^\n]{{2,{longest}}})"), F.lit(1)), "label", LABEL_SCORE if label == labels[0] else SYNONYM_SCORE) for label in (*labels, *synonyms)]
    stated = pages.select("doc_id", "page", F.explode(F.flatten(F.array(*found))).alias("c")).select("doc_id", "page", "c.*")
    row, c = F.col("cells"), []
    rest = F.trim(F.array_join(F.slice(row, 2, F.size(row)), " "))
    joined = F.lower(F.array_join(row, " "))
    score = F.lit(CELL_SCORE) + F.when(F.col("title") != "", TITLED).otherwise(0)
    for name, labels, synonyms, _, _, longest in fields:
        cell = lambda way, value, s, n=name, m=longest: F.struct(F.lit(n).alias("field"), F.lit(way).alias("way"), _clean(value, m).alias("value"), s.alias("score"))
        for label in (*labels, *synonyms):
            c.append(F.when((F.size(row) >= 2) & F.contains(F.lower(row[0]), F.lit(label.lower())), cell("cell", rest, score)))
            near = F.regexp_extract(joined, rf"(?i){label}[^:]{{0,20}}[:\s]+([^\n]+)", 1)
            c.append(F.when((F.size(row) >= 2) & (near != ""), cell("cell", near, score)))
            at = _column_with(label)
            value = F.coalesce(F.nullif(F.try_element_at(row, at + 1), F.lit("")), F.nullif(F.try_element_at(row, F.lit(2)), F.lit("")), F.lit(""))
            c.append(F.when(at > 0, cell("column", value, F.lit(COLUMN_SCORE))))
    tabled = page_tables(pages).select("doc_id", "page", F.explode(F.array_compact(F.array(*c))).alias("c")).select("doc_id", "page", "c.*")
    return stated.unionByName(tabled).where(F.char_length("value") >= 2)


def field_winners(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, value, page, way, score, n_ways): the best candidate of a field by score, page, way and value; and in how many ways its value was found."""
    each = candidates.groupBy("doc_id", "field", "value").agg(F.min(F.struct((-F.col("score")).alias("s"), "page", "way")).alias("b"), F.countDistinct("way").alias("n_ways"))
    best = F.min(F.struct("b.s", "b.page", "b.way", "value", "n_ways")).alias("w")
    return each.groupBy("doc_id", "field").agg(best).select("doc_id", "field", "w.value", "w.page", "w.way", (-F.col("w.s")).alias("score"), "w.n_ways")


def field_confidence(form: Column, context: Column, section: Column, heading: Column, table: Column, verified: Column, cross: Column) -> Column:
    """Confidence of a field from its evidence: each between 0 and 1, the heading's up to 0.15; at most 0.97, two decimals."""
    one = lambda x: F.least(F.lit(1.0), x)
    total = form * 0.32 + one(context) * 0.22 + section * 0.12 + one(heading / 0.15) * 0.08 + one(table) * 0.12 + one(verified) * 0.1
    total = total + F.when(cross >= 1, 0.06).when(cross >= 0.7, 0.04).otherwise(0.02)
    total = total + F.when((form >= 0.88) & (context >= 0.4) & (table >= 0.5), 0.03).otherwise(0.0) + F.when((verified >= 0.85) & (form >= 0.8), 0.02).otherwise(0.0)
    return F.floor(F.least(F.lit(0.97), F.greatest(F.lit(0.0), total)) * 100 + 0.5) / 100
