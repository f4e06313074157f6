"""Labels resolved by a registry that is a table: joins on keys and tokens, never label by entry.

A registry may have any number of entries. Labels are made different first, and their keys and tokens computed once. Exact
names meet by their key. Token overlap is a similarity join: two sets that share a part ``t`` of their union have a word in
common among the first n - ceil(t n) + 1 words of each, whatever the order of words is, so only those prefixes are
joined. Longer words come first, as they are the rarer ones. Sides are small or large as they are; the planner sees their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import aliases as al
from quillon.functions import text as tx

#: Least overlaps of a fuzzy and of a semantic match; a semantic one from SURE on needs no word inside the label.
FUZZY, SEMANTIC, SURE = 0.5, 0.45, 0.6
#: Ways in which a label may match an entry, the earlier one deciding.
EXACT, PATTERN, BY_WORDS, BY_TOKENS = range(4)


def registry_tables(spark: SparkSession, registry) -> dict:
    """Tables of a registry of (name, priority, aliases, patterns, words): ``names``, ``exact`` and ``sets`` of tokens; and the list of its ``patterns``.

    Larger registries are tables to begin with; these have the same columns.
    """
    names, exact, sets, patterns, seen = [], [], [], [], set()
    for k, (name, priority, *_) in enumerate(registry):
        names.append((k, name, priority))
        exact.append((al.plain_key(name), k, 99))
        seen.add(al.plain_key(name))
    for k, (name, _, others, pats, words) in enumerate(registry):
        for other in others:
            if al.plain_key(other) not in seen:
                seen.add(al.plain_key(other))
                exact.append((al.plain_key(other), k, 95))
        sets += [(k, BY_TOKENS, al.plain_tokens(a)) for a in (name, *others)]
        if words:
            sets.append((k, BY_WORDS, list(dict.fromkeys(map(al.plain_key, words)))))
        patterns += [(k, p) for p in pats]
    return {
        "names": spark.createDataFrame(names, "k int, name string, priority int"), "exact": spark.createDataFrame(exact, "key string, k int, score int"),
        "sets": spark.createDataFrame(sets, "k int, way int, held array<string>"), "patterns": patterns,
    }


def _prefix(tokens: Column, least: float) -> Column:
    """Of a set's words, longer ones first, those that any set with so much overlap shares one of."""
    ordered = F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    return F.slice(ordered, 1, F.size(tokens) - F.ceil(F.size(tokens) * least - 1e-9).cast("int") + 1)


def resolved_labels(labels: DataFrame, tables: dict) -> DataFrame:
    """(label, standard, score, method) of the labels that an entry of the registry matches.

    Exact names count 99, aliases 95, patterns 90, semantic words 80 and a tenth of a hundred for overlap, shared tokens 80 to
    90. The best score wins, then the priority, then the order of the registry. A null or blank label matches nothing.
    """
    own = labels.select("label").where("trim(label) <> ''").distinct().withColumns({"key": tx.alias_key(F.col("label")), "tokens": tx.tokens(F.col("label"))})
    exact = own.join(tables["exact"], "key").select("label", "k", F.lit(EXACT).alias("way"), "score")
    # a pattern has no key to join by: each unfolds as a predicate that is compiled once and tried on each different label
    hit = [F.when(F.col("label").rlike(p) | F.col("key").rlike(p), F.lit(k)) for k, p in tables["patterns"]] or [F.lit(None).cast("int")]
    tried = own.select("label", F.explode(F.array_distinct(F.array_compact(F.array(*hit)))).alias("k"), F.lit(PATTERN).alias("way"), F.lit(90).alias("score"))
    sets = tables["sets"].where("size(held) > 0")
    # every set is indexed by the longest prefix that any way of matching asks for
    index = sets.withColumn("token", F.explode(_prefix(F.col("held"), SEMANTIC)))
    met = own.where("size(tokens) > 0").withColumn("token", F.explode(_prefix(F.col("tokens"), SEMANTIC))).join(index, "token")
    met = met.drop("token").distinct().withColumn("overlap", tx.jaccard(F.col("tokens"), F.col("held")))
    holds = F.exists("held", lambda w: F.contains(F.col("key"), w))
    by_words = F.when((F.col("overlap") >= SEMANTIC) & (holds | (F.col("overlap") >= SURE)), F.floor(80.5 + F.col("overlap") * 10).cast("int"))
    alike = met.withColumn("score", F.when(F.col("way") == BY_WORDS, by_words).otherwise(tx.fuzzy_score(F.col("overlap")))).where("score is not null")
    ways = exact.unionByName(tried).unionByName(alike.select("label", "k", "way", "score"))
    # of one entry the earliest way counts, and its best score
    best = ways.groupBy("label", "k").agg(F.min(F.struct("way", (-F.col("score")).alias("s"))).alias("b")).select("label", "k", "b.*").join(tables["names"], "k")
    first = F.min(F.struct((F.col("way") > EXACT).alias("later"), "s", (-F.col("priority")).alias("p"), "k", "name", "way")).alias("f")
    found = best.groupBy("label").agg(first).select("label", "f.*")
    method = F.when(F.col("way") == PATTERN, "pattern").when(F.col("way") > PATTERN, "semantic").when(F.col("s") == -99, "exact_canonical").otherwise("exact_alias")
    return found.select("label", F.col("name").alias("standard"), (-F.col("s")).alias("score"), method.alias("method"))
