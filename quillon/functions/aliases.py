"""Keys of labels, and expressions for a handful of known names.

A registry is a tuple of (standard name, priority, aliases, patterns, semantic words); ``operators.labels`` matches
labels with one of any size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as tx


def plain_key(label: str) -> str:
    """``alias_key`` of a known label."""
    out = re.sub(r"[()\[\]]", " ", re.sub(r"[:\-–—.]+", " ", label.lower()))
    return re.sub(r"\s+", " ", out).strip()


def plain_tokens(label: str) -> list[str]:
    return list(dict.fromkeys(w for w in plain_key(label).split(" ") if len(w) >= 2 and w not in tx.STOP_WORDS))


def exact(label: Column, registry) -> Column:
    """struct<name, score>: the entry whose name (99) or, first one first, whose alias (95) a label is; null without one."""
    key, taken, out = tx.alias_key(label), set(), []
    for name, *_ in registry:
        taken.add(plain_key(name))
        out.append(F.when(key == plain_key(name), F.struct(F.lit(name).alias("name"), F.lit(99).alias("score"))))
    for name, _, aliases, *_ in registry:
        for alias in aliases:
            if plain_key(alias) not in taken:
                taken.add(plain_key(alias))
                out.append(F.when(key == plain_key(alias), F.struct(F.lit(name).alias("name"), F.lit(95).alias("score"))))
    return F.coalesce(*out)


def closest(label: Column, names: list[str], similarity: float = 0.84) -> Column:
    """The known name nearest to a label by edit distance, from a similarity on; null without one. The first wins ties."""
    key = F.lower(label)
    ways = [F.struct((-tx.edit_similarity(key, F.lit(n.lower()))).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(names)]
    best = F.array_min(F.array(*ways))
    return F.when(best["s"] <= -similarity, best["name"])
