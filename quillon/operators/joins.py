"""Joins. Sides are never forced to broadcast: their measured size lets the planner decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import top_one


def lookup(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: list[str]) -> DataFrame:
    """Left join that resolves a reference to some columns of its target."""
    return rows.join(dim.select(F.col(dim_key).alias(key), *columns), key, "left")


def within(rows: DataFrame, ids: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows whose key is among ``ids``. As long as it isn't ``strict``, an empty id list lets all rows through."""
    ids = ids.select(F.col(key).alias("_id")).distinct()
    hit = rows.join(ids, rows[key] == ids["_id"], "left_semi")
    if strict:
        return hit
    none = ids.limit(1).agg((F.count("*") == 0).alias("_none"))
    return hit.unionByName(rows.join(none.where("_none"), F.lit(True), "left_semi"))


def by_either(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each different key among several key columns: a disjunctive join as an equi-join."""
    return rows.withColumn(name, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Each parent with columns of its newest child, or nulls."""
    return parents.join(top_one(children, [key], order).select(key, *columns), key, "left")


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many keys were added, removed, and changed in value between two versions."""
    both = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_in_old")).join(new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in_new")), key, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return both.agg(
        count(F.col("_in_old").isNull()).alias("added"), count(F.col("_in_new").isNull()).alias("removed"),
        count(F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n"))).alias("value_changed"),
    )


def first_mention(pages: DataFrame, terms: list[tuple[str, list[str]]], text: str, key: str, page: str) -> DataFrame:
    """(key, item, page, term): the first page on which an item's terms occur, and the first such term in list order.

    ``terms`` is a fixed catalogue, so it unfolds as an array inside each row and pages are never crossed with a table.
    """
    catalogue = F.array(*[F.struct(F.lit(item).alias("item"), F.lit(k).alias("k"), F.lit(t.lower()).alias("term")) for item, ts in terms for k, t in enumerate(ts)])
    hits = pages.select(key, page, F.explode(F.filter(catalogue, lambda c: F.contains(F.lower(F.col(text)), c["term"]))).alias("h")).select(key, page, "h.*")
    return top_one(hits, [key, "item"], [F.col(page).asc(), F.col("k").asc()]).select(key, "item", F.col(page).alias("page"), "term")


def fuzzy_pairs(values: DataFrame, column: str, similarity: float) -> DataFrame:
    """(a, b, similarity) of different values alike by edit distance.

    A value of n characters allows (1 - similarity) n edits. Cut into one segment more than that, one segment of the longer
    value stays whole in the shorter one, shifted by as many places at most; so values meet on (length, segment,
    its text) and only those are compared. Values too short to have as many segments meet on empty ones.
    """
    v = values.select(F.col(column).alias("a")).where("a is not null").distinct().withColumn("n", F.char_length("a"))
    edits = F.floor((1 - F.lit(similarity)) * F.col("n") + F.lit(1e-9)).cast("int")
    start, stop = F.floor(F.col("i") * F.col("n") / (F.col("e") + 1)).cast("int"), F.floor((F.col("i") + 1) * F.col("n") / (F.col("e") + 1)).cast("int")
    cut = lambda rows: rows.withColumn("e", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e")))).withColumns({"at": start, "len": stop - start})
    long = cut(v).select("a", "n", "i", F.substr("a", F.col("at") + 1, F.col("len")).alias("part"))
    short = v.select(F.col("a").alias("b"), F.col("n").alias("m"))
    short = cut(short.withColumn("n", F.explode(F.sequence(F.col("m"), F.floor(F.col("m") / similarity + 1e-9).cast("int")))))
    shifted = short.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("e")), F.col("at") + F.col("e"))))
    shifted = shifted.where("at + len <= m").select("b", "m", "n", "i", F.substr("b", F.col("at") + 1, F.col("len")).alias("part")).distinct()
    met = long.join(shifted, ["n", "i", "part"]).where((F.col("n") > F.col("m")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    alike = 1 - F.levenshtein("a", "b") / F.greatest(F.char_length("a"), F.char_length("b"))
    found = met.withColumn("s", alike).where(F.col("s") >= similarity)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("s", 4).alias("similarity")).distinct()


def first_with_terms(rows: DataFrame, key: str, order: str, text: Column, items: list[tuple[str, list[str]]], columns: list[str], shortest: int = 0) -> DataFrame:
    """(key, item, columns): for each item of a fixed catalogue the first row of a key whose text holds one of its terms.

    Terms of ``shortest`` characters or fewer don't count. The catalogue unfolds inside each row, and firsts combine before the shuffle.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    held = []
    for item, terms in items:
        hit = F.lit(False)
        for t in terms:
            if len(t) > shortest:
                hit = hit | F.contains(low, F.lit(t.lower()))
        held.append(F.when(hit, F.lit(item)))
    hits = rows.select(key, order, *columns, F.explode(F.array_compact(F.array(*held))).alias("item"))
    best = F.min_by(F.struct(*columns), F.struct(order, *columns))
    return hits.groupBy(key, "item").agg(best.alias("_b")).select(key, "item", "_b.*")
