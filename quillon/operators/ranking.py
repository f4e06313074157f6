"""Ranking, first-of-key and chunking over explicit orders. Top-one filters prune inside tasks before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, which should be total."""
    return numbered(df, keys, order, "_r").where("_r = 1").drop("_r")


def winners_and_losers(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows with rank, rank_winner, and for losers the reason."""
    out = numbered(df, keys, order)
    return out.withColumn("rank_winner", F.col("rank") == 1).withColumn("reject_reason", F.when(F.col("rank") > 1, "duplicate_lower_rank"))


def with_history(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The winner of each key with its losers, in order, as duplicate_history.

    The history is an array by its nature; where a key may have very many losers, ``winners_and_losers`` keeps them as rows.
    """
    ranked = numbered(df, keys, order)
    lost = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", *columns))))
    best = F.min_by(F.struct(*columns), "rank")
    return ranked.groupBy(*keys).agg(best.alias("_b"), lost.alias("duplicate_history")).select(*keys, "_b.*", "duplicate_history")


def suffixed(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Unique keys: repeats of a key get __2, __3 and so on."""
    out = numbered(df, [key], order, "_r")
    return out.withColumn(name, F.when(F.col("_r") > 1, F.concat(F.col(key).cast("string"), F.lit("__"), F.col("_r").cast("string"))).otherwise(F.col(key).cast("string"))).drop("_r")


def merged_by_priority(df: DataFrame, key: str, sources: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with value, value_source and notes: the first valid of several source columns, notes on the ones turned down."""
    value, source, notes = F.lit(None).cast("string"), F.lit(None).cast("string"), []
    for name, valid in reversed(sources):
        good = F.coalesce(valid, F.lit(False))
        value, source = F.when(good, F.col(name)).otherwise(value), F.when(good, F.lit(name)).otherwise(source)
    for name, valid in sources:
        notes.append(F.when(F.col(name).isNotNull() & ~F.coalesce(valid, F.lit(False)), F.concat(F.lit(name), F.lit(": rejected"))))
    return df.select(key, value.alias("value"), source.alias("value_source"), F.array_join(F.array_compact(F.array(*notes)), "; ").alias("notes"))


def chunked(pages: DataFrame, key: str, page: str, text: str, size: int = 5) -> DataFrame:
    """(key, chunk, page_numbers, text): every ``size`` consecutive pages as one chunk, texts under page marks in order."""
    at = numbered(pages, [key], [F.col(page).asc()], "_r").withColumn("chunk", F.floor((F.col("_r") - 1) / size).cast("int"))
    marked = F.concat(F.lit("--- PAGE "), F.col(page).cast("string"), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit("")))
    got = at.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), marked.alias("t")))).alias("c"))
    return got.select(key, "chunk", F.transform("c", lambda x: x["p"]).alias("page_numbers"), F.array_join(F.transform("c", lambda x: x["t"]), "\n\n").alias("text"))


def packed(pages: DataFrame, key: str, page: str, chars: str, budget: int) -> DataFrame:
    """(key, page, pack): pages in order into packs of at most ``budget`` characters; a longer page has a pack alone.

    A running sum with resets is a fold, so each key's (page, length) pairs are folded as one array: sizes, not texts.
    """
    sized = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("long").alias("p"), F.coalesce(F.col(chars), F.lit(0)).cast("long").alias("n")))).alias("a"))
    kind = "struct<pack:int,used:bigint,out:array<struct<p:bigint,pack:int>>>"
    zero = F.expr(f"cast(named_struct('pack', 0, 'used', 0L, 'out', array()) as {kind})")

    def step(acc: Column, x: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + x["n"] > budget)
        pack = F.when(full, acc["pack"] + 1).otherwise(acc["pack"])
        used = F.when(full, x["n"]).otherwise(acc["used"] + x["n"])
        return F.struct(pack.alias("pack"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["p"].alias("p"), pack.alias("pack")))).alias("out")).cast(kind)

    return sized.select(key, F.explode(F.aggregate("a", zero, step, lambda acc: acc["out"])).alias("o")).select(key, F.col("o.p").alias(page), F.col("o.pack").alias("pack"))


def islands(rows: DataFrame, keys: list[str], order: str, member: Column, least: int = 2) -> DataFrame:
    """(keys, first, last, n): runs of at least ``least`` consecutive rows that are members."""
    w = Window.partitionBy(*keys).orderBy(order)
    tagged = rows.withColumn("_m", F.coalesce(member, F.lit(False))).withColumn("_b", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(w))
    got = tagged.where("_m").groupBy(*keys, "_b").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return got.where(F.col("n") >= least).drop("_b")


def merged_values(rows: DataFrame, key: str, value: str, confidence: str) -> DataFrame:
    """(key, value, confidence): values of a key without near repeats, each with the best confidence of its repeats.

    Values count as equal by lower case and single spaces; two of over 30 characters also where one holds the other.
    Exact repeats combine before the shuffle; what is left of a key, a list of different values, is merged in order of length.
    """
    text = F.trim(F.regexp_replace(F.col(value), r"\s+", " "))
    plain = rows.where(text != "").groupBy(key, F.lower(text).alias("_k")).agg(F.min(text).alias("v"), F.max(confidence).alias("c"))
    items = plain.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.char_length("_k")).alias("n"), F.col("_k").alias("k"), F.col("v").alias("v"), F.col("c").alias("c")))).alias("a"))
    held = "array<struct<k:string,v:string,c:double>>"

    def step(kept: Column, x: Column) -> Column:
        same = lambda o: (F.char_length(x["k"]) > 30) & (F.char_length(o["k"]) > 30) & (F.contains(o["k"], x["k"]) | F.contains(x["k"], o["k"]))
        lifted = F.transform(kept, lambda o: F.struct(o["k"].alias("k"), o["v"].alias("v"), F.when(same(o), F.greatest(o["c"], x["c"].cast("double"))).otherwise(o["c"]).alias("c")))
        own = F.array(F.struct(x["k"].alias("k"), x["v"].alias("v"), x["c"].cast("double").alias("c")))
        return F.when(F.exists(kept, same), lifted).otherwise(F.concat(kept, own)).cast(held)

    return items.select(key, F.explode(F.aggregate("a", F.expr(f"cast(array() as {held})"), step)).alias("m")).select(key, F.col("m.v").alias(value), F.col("m.c").alias(confidence))


def changed(rows: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """Rows whose value is not the one of the row before them of the same key."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_last", before).where(~F.col("_last").eqNullSafe(F.col(column))).drop("_last")
