"""Quality rules by robust multivariate outliers.

Simple statistics of every text are transformed into a vector. Per language and source the minimum-covariance-
determinant estimate gives the centre and shape of the bulk of the vectors, and a document is rejected where its
Mahalanobis distance from that bulk, on the bad side, is too large.

The estimate is the covariance of those three quarters of a group whose covariance has the least determinant. Several
starts (medians, all vectors, halves by hashes) are concentrated at once: each step takes the three quarters of a group
nearest to a start's last estimate and estimates anew, which never raises the determinant; the start that ends with the least one
counts. The covariance is scaled by the consistency factor of the share, and a small diagonal is added, as statistics may
be constant in a group; so groups of any size, one document included, are judged by the same rule. Steps run over all documents as
aggregations; only a few sums per group and start reach the small linear algebra, which runs in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize
from quillon.llm.grams import WORD_BASE, ranges, slices

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
DIMS = 5
#: Share of a group that the estimate rests on, the accuracy of the quantile that takes the share, and the fall of a log determinant below which a start has settled.
SHARE, ACCURACY, SETTLED = 0.75, 10_000, 1e-6
#: Ways in which a hash halves every group; each half is a start.
HALVINGS = 3
#: Least standard deviation of each transformed statistic: what differs by less is alike.
FLOORS = (0.5, 0.08, 0.03, 0.05, 0.05)
#: Squared distance beyond which a vector is an outlier: chi-square with 5 degrees of freedom, 1 in 10^9 above.
CUTOFF = 50.8


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True
    for batch in batches:
        for words in slices(batch.column("text")):
            texts = len(words.first) - 1
            n = words.lengths()
            data = words.data
            per_text = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[words.text_at])
            lead = (data & 0xC0) != 0x80  # first bytes of code points
            spaces = np.isin(data, (9, 10, 11, 12, 13, 32))
            chars, symbols = per_text(lead & ~spaces), per_text(is_symbol[data])
            # words in runs of three that occur twice or more in their text
            h, owner = words.hashes(), words.owner()
            covered = np.zeros(len(h), dtype=bool)
            at = np.arange(max(0, len(h) - 2))
            at = at[at + 3 <= words.first[1:][owner[at]]]
            if len(at):
                g = ranges(h, WORD_BASE, at, at + 3)
                order = np.lexsort((g, owner[at]))
                so, sg = owner[at][order], g[order]
                same = (so[1:] == so[:-1]) & (sg[1:] == sg[:-1])
                twice = np.zeros(len(at), dtype=bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                for k in range(3):
                    covered[at[twice] + k] = True
            repeats = np.bincount(owner[covered], minlength=texts)
            # lines with a word that equal an earlier line of their text
            breaks = np.flatnonzero(data == 10)
            begin = np.unique(np.concatenate([breaks + 1, words.text_at[:-1]]))
            begin = begin[begin < len(data)]
            text_end = words.text_at[np.searchsorted(words.text_at, begin, side="right")] if len(begin) else begin
            end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], text_end)
            line_owner = np.searchsorted(words.text_at, begin, side="right") - 1
            with_word = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, begin)
            begin, end, line_owner = begin[with_word], end[with_word], line_owner[with_word]
            dups = np.zeros(texts, dtype=np.int64)
            if len(begin):
                line = ranges(data.astype(np.uint64) + np.uint64(1), WORD_BASE, begin, end)
                order = np.lexsort((line, line_owner))
                lo, lh = line_owner[order], line[order]
                dups = np.bincount(lo[1:][(lo[1:] == lo[:-1]) & (lh[1:] == lh[:-1])], minlength=texts)
            own = batch.slice(words.rows.start, texts)
            names = [c for c in own.schema.names if c != "text"]
            stats = [pa.array(np.asarray(x, dtype=np.int64)) for x in (n, chars, symbols, dups, repeats)]
            yield pa.RecordBatch.from_arrays([own.column(c) for c in names] + stats, names=names + list(STATS))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the five statistics of every whole text; a null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(_stat_batches, "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS))


def _vector() -> list[Column]:
    """The transformed statistics: size, word length, symbols, repeated lines and repeated runs, the last three as roots."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


X = [f"x{i}" for i in range(DIMS)]
KEYS = ["lang", "source", "start"]


def chi_square(x: float, k: int) -> float:
    """The chi-square distribution function, by its series."""
    term = total = 1.0
    for n in range(1, 400):
        term *= x / (k + 2 * n)
        total += term
    return (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1) * total


def consistency(share: float, dims: int = DIMS) -> float:
    """The factor that makes the covariance of the inner ``share`` of normal vectors that of all."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < share else (low, mid)
    return share / chi_square(low, dims + 2)


def _moments() -> list[Column]:
    sums = [F.sum(x).alias(f"s_{x}") for x in X]
    return [F.count("*").alias("n"), *sums, *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s_{i}_{j}") for i in range(DIMS) for j in range(i, DIMS)]]


def _shapes(factor: float):
    """Per group and start, from sums: the centre, the inverse of the covariance, and the logarithm of its determinant."""
    floor = np.diag(np.square(FLOORS))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                n = max(r["n"], 1)
                mean = np.array([r[f"s_{x}"] for x in X]) / n
                second = np.zeros((DIMS, DIMS))
                for i in range(DIMS):
                    for j in range(i, DIMS):
                        second[i, j] = second[j, i] = r[f"s_{i}_{j}"] / n
                covariance = factor * (second - np.outer(mean, mean)) + floor
                out.append((r["lang"], r["source"], r["start"], mean.tolist(), np.linalg.inv(covariance).ravel().tolist(), float(np.linalg.slogdet(covariance)[1])))
            yield pd.DataFrame(out, columns=[*KEYS, "centre", "inverse", "log_det"])

    return solve


SHAPE = "lang string, source string, start int, centre array<double>, inverse array<double>, log_det double"


def _distance(one_sided: bool = False) -> Column:
    """The squared Mahalanobis distance; one-sided: fewer symbols or repeats than usual count as usual, so clean texts are no outliers."""
    diff = [F.col(x) - F.col("centre")[i] for i, x in enumerate(X)]
    if one_sided:
        diff = [*diff[:2], *[F.greatest(d, F.lit(0.0)) for d in diff[2:]]]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(DIMS):
            total = total + diff[i] * diff[j] * F.col("inverse")[i * DIMS + j]
    return total


def _join(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    groups = groups.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(groups[f"_{k}"])
    return rows.join(groups, same).drop(*[f"_{k}" for k in keys])


def robust_shapes(vectors: DataFrame, share: float = SHARE) -> DataFrame:
    """(lang, source, centre, inverse, log_det): the minimum-covariance-determinant estimate of each group.

    ``vectors`` has lang, source and x0..x4. Every start is concentrated until its determinant falls no more; those that have settled
    leave the steps that follow. Groups are tables written to the shared folder, so their true size decides
    how they are joined; sums and quantile sketches combine before any shuffle, so a hot group costs no more than
    its share of a scan. The share of a group is taken by a quantile sketch of relative rank error 1 / ``ACCURACY``.
    """
    factor = consistency(share)
    group = lambda rows, start: rows.groupBy("lang", "source", start.cast("int").alias("start"))
    medians = vectors.groupBy("lang", "source").agg(F.array(*[F.percentile_approx(x, 0.5, ACCURACY) for x in X]).alias("centre"))
    spread = [1.0 / f**2 if i == j else 0.0 for i, f in enumerate(FLOORS) for j in range(DIMS)]
    medians = medians.select("lang", "source", F.lit(0).alias("start"), "centre", F.array(*[F.lit(v) for v in spread]).alias("inverse"), F.lit(None).cast("double").alias("log_det"))
    halved = vectors.select("*", F.explode(F.array(*[F.pmod(F.xxhash64(*X, F.lit(k)), F.lit(2)) + 2 * k + 2 for k in range(HALVINGS)])).alias("half"))
    counted = group(vectors, F.lit(1)).agg(*_moments()).unionByName(group(halved, F.col("half")).agg(*_moments()))
    # what starts begin with is no estimate of the share yet, so its determinant is not compared
    begun = counted.mapInPandas(_shapes(factor), SHAPE).withColumn("log_det", F.lit(None).cast("double"))
    shapes, settled = materialize(medians.unionByName(begun), "mcd-0"), []
    step = 0
    while not step or not shapes.isEmpty():
        step += 1
        near = _join(vectors, shapes).withColumn("d", _distance()).drop("centre", "inverse", "log_det")
        limits = materialize(near.groupBy(*KEYS).agg(F.percentile_approx("d", share, ACCURACY).alias("limit")), f"mcd-limit-{step}")
        inside = _join(near, limits, ("lang", "source", "start")).where("d <= limit")
        new = inside.groupBy(*KEYS).agg(*_moments()).mapInPandas(_shapes(factor), SHAPE)
        before = shapes.select(*KEYS, *[F.col(c).alias(f"old_{c}") for c in ("centre", "inverse", "log_det")])
        both = materialize(_join(new, before, ("lang", "source", "start")).withColumn("falls", F.coalesce(F.col("log_det") < F.col("old_log_det") - SETTLED, F.lit(True))), f"mcd-{step}")
        discard(limits, shapes)
        settled.append(both)
        shapes = materialize(both.where("falls").select(*KEYS, "centre", "inverse", "log_det"), f"mcd-on-{step}")
    discard(shapes)
    ended = settled[0].where("not falls")
    for more in settled[1:]:
        ended = ended.unionByName(more.where("not falls"))
    best = ended.groupBy("lang", "source").agg(F.min_by(F.struct(F.col("old_centre").alias("centre"), F.col("old_inverse").alias("inverse"), F.col("old_log_det").alias("log_det")), F.struct("old_log_det", "start")).alias("b"))
    best = materialize(best.select("lang", "source", "b.*"), "mcd-best")
    discard(*settled)
    return best


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, lang, source, the statistics, base_failed, distance, kept), one row a document.

    Null languages and sources are groups like others. Repeated rows stay and are judged alike. A null or
    empty text fails the base rules. Other columns are ignored. An empty table gives an empty result.
    """
    stats = text_statistics(docs)
    for x, v in zip(X, _vector()):
        stats = stats.withColumn(x, v)
    stats = materialize(stats.withColumn("base_failed", base_failed()), "rules-stats")
    judged = _join(stats, robust_shapes(stats.select("lang", "source", *X))).withColumn("distance", _distance(one_sided=True))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return judged.select("doc_id", "lang", "source", *STATS, "base_failed", "distance", kept.alias("kept"))
