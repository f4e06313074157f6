"""Document operators: pages, quality of scans, repeated lines, normalised records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx


def paginate(docs: DataFrame, key: str, text: str, size: int = 3000) -> DataFrame:
    """(key, page_number, text): at form feeds or three newlines where there are any, else in even slices of words."""
    marks = F.filter(F.split(text, r"\f|\n{3,}"), lambda p: F.trim(p) != "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    parts = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size)).cast("int")
    per = F.ceil(F.size(words) / parts).cast("int")
    even = F.filter(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.array_join(F.slice(words, i * per + 1, F.greatest(F.lit(1), per)), " ")), lambda p: p != "")
    pages = F.when(F.size(marks) > 1, marks).otherwise(even)
    return docs.select(key, F.posexplode(pages).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)


def scanned(pages: DataFrame, key: str, chars: str = "char_count", least: int = 40) -> DataFrame:
    """(key, sparse_share, is_scanned): scanned where 60 % of the pages have under 40 characters, or ``least``."""
    share = F.avg(F.when(F.col(chars) < least, 1.0).otherwise(0.0))
    return pages.groupBy(key).agg(F.round(share, 4).alias("sparse_share"), (share >= 0.6).alias("is_scanned"))


def scan_quality(pages: DataFrame, key: str, chars: str = "char_count") -> DataFrame:
    """(key, pages, avg_chars, coverage, score). The mean is rounded before the density is taken of it."""
    got = pages.groupBy(key).agg(F.count("*").alias("pages"), F.floor(F.avg(chars) + 0.5).alias("avg_chars"), F.avg(F.when(F.col(chars) >= 40, 1.0).otherwise(0.0)).alias("coverage"))
    density = F.least(F.lit(1.0), F.col("avg_chars") / 2000)
    return got.withColumn("score", F.floor(F.least(F.lit(100.0), F.col("coverage") * 55 + density * 45) + 0.5)).withColumn("coverage", F.round("coverage", 4))


def repeated_lines(pages: DataFrame, key: str, page: str, text: str, least: int = 3, shortest: int = 8, longest: int = 120) -> DataFrame:
    """(key, line, pages): lines, in lower case, that stand on at least ``least`` pages of a document and are no noise."""
    rows = pages.select(key, page, F.explode(F.array_distinct(F.transform(tx.lines(F.col(text)), F.lower))).alias("line"))
    rows = rows.where(F.char_length("line").between(shortest, longest) & ~tx.is_noise(F.col("line")))
    return rows.groupBy(key, "line").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def frequent_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, n): lines of one document, case kept, that occur at least max(4, lines / 200) times."""
    all_lines = tx.lines(F.col(text))
    need = F.greatest(F.lit(4), F.floor(F.size(all_lines) / 200))
    rows = docs.select(key, need.alias("need"), F.explode(F.filter(all_lines, lambda x: F.char_length(x).between(6, 120))).alias("line"))
    return rows.groupBy(key, "line").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").drop("need")


def context(pages: DataFrame, key: str, page: str, text: str, reach: int = 1, cap: int = 3000) -> DataFrame:
    """(key, page, context): the heads of each page and its neighbours by number, in order, as a band join by offset."""
    near = pages.select(key, F.col(page).alias("_p"), F.substring(text, 1, cap).alias("_t"))
    shifted = near.select(key, "_p", "_t", F.explode(F.sequence(F.col("_p") - reach, F.col("_p") + reach)).alias(page))
    got = pages.select(key, page).join(shifted, [key, page]).groupBy(key, page).agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("c"))
    return got.select(key, page, F.array_join(F.transform("c", lambda x: x["_t"]), "\n").alias("context"))


def html_text(html):
    """The text of a web page: no scripts, styles or tags; blocks end lines."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"[ \t]+", " ")


def ranges(pages: DataFrame, key: str, page: str, tags: str) -> DataFrame:
    """(key, tags, first, last): neighbouring pages of equal tags as one range."""
    by_tags = Window.partitionBy(key, tags).orderBy(page)
    island = F.col(page) - F.row_number().over(by_tags)
    return pages.withColumn("_g", island).groupBy(key, tags, "_g").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_g")
