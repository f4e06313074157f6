"""Names of parameters mapped to fields by a registry of aliases: equi-joins on the parts of a name, least rule first.

An alias counts where it stands between boundaries of a name. So each different name is taken apart into all the parts that
begin and end at boundaries and are no longer than the longest alias, and those parts meet the aliases by equality. Neither the
number of rules nor of names makes the join quadratic, and the planner sees the registry's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def registry(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(alias, rule, target) of rules (target, aliases): rules with a longer alias come first, else in their order."""
    ordered = sorted(rules, key=lambda r: -max(map(len, r[1])))
    first = {}
    for k, (target, aliases) in enumerate(ordered):
        for a in aliases:
            first.setdefault(a, (k, target))
    return spark.createDataFrame([(a, k, t) for a, (k, t) in first.items()], "alias string, rule int, target string")


def _parts(name: Column, longest: int, anywhere: bool) -> Column:
    """The parts of a name that begin at its start, or behind white space, a colon or a dash, and end before white space, a colon, or at its end."""
    at = F.sequence(F.lit(1), F.char_length(name))
    char = lambda i: F.substr(name, i, F.lit(1))
    starts = F.filter(at, lambda i: (i == 1) | char(F.greatest(i - 1, F.lit(1))).rlike(r"^[\s:–\-]$")) if anywhere else F.array(F.lit(1))
    ends = F.filter(at, lambda i: (i == F.char_length(name)) | char(i + 1).rlike(r"^[\s:]$"))
    cut = F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: (e >= s) & (e - s < longest)), lambda e: F.substr(name, s, e - s + 1)))
    return F.array_distinct(F.flatten(cut))


def mapped_names(names: DataFrame, aliases: DataFrame, exact: DataFrame | None = None, anywhere: bool = True, shortest: int = 1) -> DataFrame:
    """(name, target, way) of the different names that a rule maps.

    ``exact`` (name, target) goes first; then a name that is an alias; then aliases of ``shortest`` characters or more inside
    the name, or only at its start. Of several the least rule wins. With ``anywhere``, an alias that is the name ranks as one inside it does.
    """
    longest = aliases.agg(F.max(F.char_length("alias"))).first()[0] or 1
    own = names.select("name").where("name <> ''").distinct()
    parts = own.select("name", F.explode(_parts(F.col("name"), longest, anywhere)).alias("alias"))
    whole = F.col("alias") == F.col("name")
    way = F.lit(1) if anywhere else F.when(whole, 1).otherwise(2)
    hits = parts.join(aliases, "alias").where(whole | (F.char_length("alias") >= shortest)).select("name", way.alias("way"), "rule", "target")
    if exact is not None:
        hits = hits.unionByName(own.join(exact, "name").select("name", F.lit(0).alias("way"), F.lit(0).alias("rule"), "target"))
    return hits.groupBy("name").agg(F.min(F.struct("way", "rule", "target")).alias("m")).select("name", "m.target", "m.way")


def mapping_winners(pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """(doc_id, target, value, name, page, confidence): each document's value of a field, by confidence, then page, place and value.

    ``pairs`` has doc_id, page, place, name, value, confidence.
    """
    rows = pairs.join(mapped, "name")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "page", "place", "value", "name")).alias("b")
    return rows.groupBy("doc_id", "target").agg(best).select("doc_id", "target", "b.value", "b.name", "b.page", (-F.col("b.c")).alias("confidence"))
