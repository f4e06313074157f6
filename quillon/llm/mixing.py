"""Mixing sources to target weights.

Word counts are aggregated per source, the targets follow by filling sources up to a cap, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, column, materialize, numbered

#: Weights of the sources by rank, repeating, and the most a source may be repeated.
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed, the key and the text alone, so rows without a key draw apart."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Sources rank by code point, a null source last; ``weights`` repeat over the ranks. All words are
    shared out by weight; a source stops at ``max_repeats`` times its own words and the excess goes to
    the others by weight until none is above. That fixed point is one water level: target =
    least(cap, level * weight), where the level follows from sums over sources in order of cap / weight.
    The windows run over one row a source, never over documents. Sources without words get 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("r") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("r", rank).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("r").asc())
    every = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_weight"))
    )
    # the level holds from the first source on whose cap it does not reach
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("filled", "level"))).over(every)
    return per.withColumn("level", first["level"]).select(
        "source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target")
    )


def plan_mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (how often the mix takes the document).

    A null text has no words. Rows that repeat both key and text draw alike; a null key counts as an empty one. Reruns
    agree, as the draw depends on key, text and seed alone. Columns of ``docs`` with one of the new names
    are replaced, all others stay, whatever their names. The per-source table is written to the shared folder, so its true size decides on a
    broadcast, and a hot source never meets in one task: it is summed before the shuffle.
    """
    new = ["size", "source_size", "target", "rate", "copies"]
    docs = docs.drop(*new).withColumn("size", word_count(F.col("text")))
    per = materialize(source_targets(docs.select("source", "size"), weights, max_repeats), "mix-targets")
    # a name that no column of the caller has
    own = "_source" + "_" * max((len(c) for c in docs.columns), default=0)
    per = per.select(F.col("source").alias(own), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = docs.join(per, docs["source"].eqNullSafe(per[own])).drop(own).withColumn("rate", rate)
    extra = draw(column(key), F.col("text"), seed) < F.col("rate") - F.floor("rate")
    return out.withColumn("copies", F.floor("rate").cast("long") + extra.cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as ``plan_mix`` says, its own columns unchanged whatever their names."""
    inner, names = numbered(docs, {"key": column(key), "text": F.col("text"), "source": F.col("source")})
    planned = plan_mix(inner, "key", **options).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return planned.withColumn("_copy", copy).select(*names).toDF(*docs.columns)
