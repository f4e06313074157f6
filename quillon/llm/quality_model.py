"""Quality classifier from weak labels.

Overlapping heuristic labellers, and reviewers where they saw a document, vote on every document for two
tasks: is it of low quality, is it toxic. One labeller knows words of abuse, another the terms that set texts apart which reviewers
call toxic, in whatever language: they are learnt from the reviewed texts of the bounded sample. Expectation-maximisation over the counts of vote patterns of all documents
estimates how each labeller votes on either class, which gives every pattern a posterior. A hashed
linear scorer per task learns these posteriors on a bounded sample and then judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import discard, materialize, numbered
from quillon.llm.grams import SPACE, WORD_BASE, Words, mix64, ranges, slices
from quillon.llm.quality_rules import SYMBOLS

#: Words of abuse.
ABUSE = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
TASKS = ("low_quality", "toxic")
#: The labellers of each task; the last of a task are the reviewers.
LABELLERS = {
    "low_quality": ("symbols", "repetition", "shouting", "diversity", "emphasis", "odd_characters", "odd_endings", "reviewed_quality"),
    "toxic": ("abuse_words", "learned_terms", "reviewed_toxic"),
}
ABSTAIN, FINE, BAD = 0, 1, 2
#: Hashed features, and about how many reviewed and how many other documents the scorers are fitted on at most.
FEATURES, FIT_ROWS = 1 << 16, (7_000, 3_500)
#: What is believed of reviewers before any document is seen: right and wrong votes of each class. Their accuracy is estimated like all others.
REVIEWED = (19.0, 1.0)
#: Weight in the fit of documents on which all labellers are silent, where reviewers have seen others.
SILENT_WEIGHT = 0.1
N_STATS = 8
#: A term is learnt if so many reviewed toxic texts hold it, and so large a share of all reviewed texts with it are toxic, two toxic ones left out; at most so many terms.
TERM_TEXTS, TERM_SHARE, MOST_TERMS = 5, 0.6, 20_000


ODD = np.zeros(256, dtype=bool)
ODD[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _abuse_hashes() -> np.ndarray:
    said = [w + end for w in ABUSE for end in ("", ",", ".", "!", "?", ";", ":")]
    return np.concatenate([w.hashes() for w in slices(pa.array(said))])


def _ratio(a, b):
    return np.asarray(a, dtype=np.float64) / np.maximum(1, b)


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-case word, and text and hash of the distinct ones of each text, in order)."""
    low = replace(words, data=np.where((words.data >= 65) & (words.data <= 90), words.data + 32, words.data).astype(np.uint8))
    h, owner = low.hashes(), words.owner()
    order = np.lexsort((h, owner))
    so, sh = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (so[1:] != so[:-1]) | (sh[1:] != sh[:-1])
    return h, so[new], sh[new]


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, and two marks that near copies share: the least hashes of its runs of three words."""
    for batch in batches:
        for words in slices(batch.column("text")):
            texts = len(words.first) - 1
            h, so, sh = _distinct(words)
            owner = words.owner()
            at = np.arange(max(0, len(h) - 2))
            at = at[at + 3 <= words.first[1:][owner[at]]]
            g, own = ranges(h, WORD_BASE, at, at + 3), owner[at]
            marks = []
            for salt in (0, 0x9E3779B97F4A7C15):
                least = np.full(texts, np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, own, mix64(g ^ np.uint64(salt)))
                marks.append(pa.array(least.view(np.int64)))
            cut = np.searchsorted(so, np.arange(texts + 1)).astype(np.int32)
            rows = batch.slice(words.rows.start, texts)
            yield pa.RecordBatch.from_arrays([rows.column("bad"), pa.ListArray.from_arrays(pa.array(cut), pa.array(sh.view(np.int64))), *marks], names=["bad", "words", "one", "two"])


def learn_terms(texts: DataFrame) -> np.ndarray:
    """The hashes of the words that set bad texts apart, sorted, of rows (bad, words, one, two).

    Of texts that share a mark only one counts, so copies bear out nothing. Words are counted by Spark; the driver gets the terms.
    """
    # the same one in every run, whatever the order of rows
    apart = texts.groupBy("one").agg(F.min(F.struct("two", "bad", "words")).alias("t")).select("one", "t.*")
    apart = apart.groupBy("two").agg(F.min(F.struct("one", "bad", "words")).alias("t")).select("t.bad", F.explode("t.words").alias("word"))
    counts = apart.groupBy("word").agg(F.sum(F.col("bad").cast("long")).alias("n_bad"), F.count("*").alias("n"))
    found = counts.where((F.col("n_bad") >= TERM_TEXTS) & (F.col("n_bad") - 2 >= TERM_SHARE * F.col("n")))
    rows = found.orderBy(F.col("n_bad").desc(), "word").limit(MOST_TERMS).select("word").toPandas()
    return np.sort(rows["word"].to_numpy(dtype=np.int64).view(np.uint64))


def _describe(words: Words, abuse: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes: text x labeller without reviewers, owner and feature of the distinct features of each text)."""
    texts = len(words.first) - 1
    n, owner = words.lengths(), words.owner()
    data = words.data
    per_text = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[words.text_at])
    size = np.diff(words.text_at)
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True
    symbols = _ratio(per_text(is_symbol[data]), size)
    upper, lower = per_text((data >= 65) & (data <= 90)), per_text((data >= 97) & (data <= 122))
    shout, marks = _ratio(upper, upper + lower), _ratio(per_text(data == 33), n)
    # neither letters, digits nor white space, over all characters but white space; words that end in one
    odd = ODD[data]
    strange, endings = _ratio(per_text(odd), per_text(~SPACE[data])), _ratio(np.bincount(owner[odd[words.ends - 1]], minlength=texts), n)
    h, so, sh = _distinct(words)
    distinct = np.bincount(so, minlength=texts)
    # runs of three words that occur again
    at = np.arange(max(0, len(h) - 2))
    at = at[at + 3 <= words.first[1:][owner[at]]]
    g = ranges(h, WORD_BASE, at, at + 3)
    go = owner[at]
    order = np.lexsort((g, go))
    again = (go[order][1:] == go[order][:-1]) & (g[order][1:] == g[order][:-1])
    repeat = _ratio(np.bincount(go[order][1:][again], minlength=texts), np.maximum(1, n - 2))
    variety = _ratio(distinct, np.sqrt(np.maximum(1, n)))  # falls with monotony, grows little with length
    kinds = lambda known: np.bincount(so[np.isin(sh, known)], minlength=texts)
    abusive, learned = kinds(abuse), kinds(terms)
    # a heuristic sees one kind of fault: it votes against a document that has it, and else abstains
    faults = [symbols > 0.05, repeat > 0.3, shout > 0.5, (variety < 1.5) & (n >= 20), marks > 0.2, strange > 0.15, endings > 0.5, abusive > 0, learned > 0]
    votes = np.where(np.stack(faults, axis=1), BAD, ABSTAIN)
    # features: distinct lower-case words, and each statistic by its level
    level = lambda x, step: np.minimum(30, np.floor(x / step)).astype(np.int64)
    stats = np.stack([level(symbols, 0.02), level(repeat, 0.05), level(shout, 0.1), level(variety, 0.5), level(marks, 0.05), level(np.log1p(n), 1.0), level(_ratio(size, n), 1.0), level(abusive + learned, 1.0)], axis=1)
    features = np.concatenate([(sh >> np.uint64(40)).astype(np.int64) % (FEATURES - 32 * N_STATS), (FEATURES - 32 * N_STATS + np.arange(N_STATS) * 32 + stats).ravel()])
    return votes, np.concatenate([so, np.repeat(np.arange(texts), N_STATS)]), features


def _vote_batches(with_features: bool, terms: np.ndarray):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        abuse = _abuse_hashes()
        for batch in batches:
            for words in slices(batch.column("text")):
                votes, owner, features = _describe(words, abuse, terms)
                texts, k = votes.shape
                arrays = [batch.column("doc_id").slice(words.rows.start, texts), pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * k), pa.array(votes.astype(np.int32).ravel()))]
                if with_features:
                    pair = np.unique(owner * FEATURES + features)
                    cut = np.searchsorted(pair, np.arange(texts + 1) * FEATURES).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(cut), pa.array((pair % FEATURES).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "votes", "features"][: len(arrays)])

    return vote


def _with_reviews(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with votes of all labellers, per task, as quality votes then toxic votes, reviewers last."""
    cut = len(LABELLERS["low_quality"]) - 1
    if labels is None:
        rows = rows.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    else:
        told = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").where("_id is not null").groupBy("_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        rows = rows.join(told, rows["doc_id"] == F.col("_id"), "left").drop("_id")
    quality = F.when(F.col("quality").isNull(), ABSTAIN).when(F.col("quality") >= 1, FINE).otherwise(BAD)
    toxic = F.when(F.col("toxic").isNull(), ABSTAIN).when(F.col("toxic") >= 1, BAD).otherwise(FINE)
    n = sum(map(len, LABELLERS.values())) - 2
    return rows.withColumns({
        "low_quality": F.concat(F.slice("votes", 1, cut), F.array(quality)),
        "toxic": F.concat(F.slice("votes", cut + 1, n - cut), F.array(toxic)),
    }).drop("votes", "quality")


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: (posterior of the bad class per pattern, its prior, accuracies).

    accuracies[class, labeller, vote] is the probability of a vote, or of none, given the class; for the reviewers, who come last, of
    a vote where they gave one, as which documents they see says nothing about those. All of them, the
    reviewers' included, are estimated from all documents; ``REVIEWED`` is their only prior. The start takes a reviewer's word, and
    else any vote against a document, so the classes keep their names.
    """
    if not len(counts):
        return np.empty(0), 0.5, np.full((2, patterns.shape[1] if patterns.ndim == 2 else 0, 3), 1 / 3)
    bad, told = (patterns[:, :-1] == BAD).any(1), patterns[:, -1]
    fine = (patterns[:, :-1] == FINE).any(1)
    posterior = np.where(told == BAD, 0.9, np.where(told == FINE, 0.05, np.where(bad & fine, 0.5, np.where(bad, 0.9, 0.05))))
    one_hot = np.stack([patterns == v for v in (ABSTAIN, FINE, BAD)], axis=2).astype(np.float64)
    one_hot[:, -1, ABSTAIN] = 0
    # documents that no reviewer saw weigh together as much as the reviewed ones at most, so they don't redefine the classes
    reviewed = counts[told != ABSTAIN].sum()
    counts = counts * np.where(told == ABSTAIN, min(1.0, reviewed / max(1.0, counts.sum() - reviewed)) if reviewed else 1.0, 1.0)
    before = np.full((2, patterns.shape[1], 3), 0.5)
    right, wrong = REVIEWED
    before[:, -1] = [[0, right, wrong], [0, wrong, right]]
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = np.clip(weight.sum(1) / counts.sum(), 1e-4, 1)
        table = np.einsum("cp,plv->clv", weight, one_hot) + before
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one_hot, np.log(np.maximum(table, 1e-12)))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < 1e-7:
            break
    return posterior, float(prior[1]), table


def fit_scorer(features: list[np.ndarray], target: np.ndarray, weight: np.ndarray, penalty: float = 2e-4, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic scorer, the bias last: proximal gradient with momentum and an absolute penalty.

    Features of fewer than three documents stay out.
    """
    w = np.zeros(FEATURES + 1)
    if not len(target):
        return w
    flat = np.concatenate(features).astype(np.int32)
    row = np.repeat(np.arange(len(target), dtype=np.int32), [len(f) for f in features])
    common = np.bincount(flat, minlength=FEATURES)[flat] >= 3
    flat, row = flat[common], row[common]
    lengths = np.bincount(row, minlength=len(target)).astype(np.float64)
    weight = weight / weight.sum()
    # a step of its own for each weight: the curvature in its rows is at most a quarter of their lengths
    curve = np.bincount(flat, weights=((lengths + 1) * weight)[row], minlength=FEATURES + 1) / 4
    curve[-1] = ((lengths + 1) * weight).sum() / 4
    rate = 1.0 / np.maximum(curve, 1e-4)
    at, last = w.copy(), w.copy()
    for t in range(1, rounds + 1):
        z = at[-1] + np.bincount(row, weights=at[flat], minlength=len(target))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        gradient = np.bincount(flat, weights=error[row], minlength=FEATURES + 1)
        gradient[-1] = error.sum()
        w = at - rate * gradient
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate[:-1] * penalty)
        at = w + (t - 1) / (t + 2) * (w - last)
        last = w
    return w


def _score_batches(weights: np.ndarray, terms: np.ndarray, names: list[str], text: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        abuse = _abuse_hashes()
        for batch in batches:
            for words in slices(batch.column(text)):
                _, owner, features = _describe(words, abuse, terms)
                texts = len(words.first) - 1
                own = batch.slice(words.rows.start, texts)
                probability = [pa.array(1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(owner, weights=w[features], minlength=texts), -30, 30)))) for w in weights]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in names] + probability, names=names + [f"p_{t}" for t in TASKS])

    return score


def _share(of: Column, wanted: int, total: int) -> Column:
    """True for about ``wanted`` of ``total`` rows, drawn by a hash."""
    return F.pmod(of, F.lit(1 << 20)) < F.lit(int(min(1.0, wanted / max(1, total)) * (1 << 20)))


def train(docs: DataFrame, labels: DataFrame | None = None, fit_rows: tuple[int, int] = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(The scorers' weights, a row a task; the learnt terms.)

    Votes are counted over all documents. Only for the terms and the fit of the scorers, about ``fit_rows`` documents at most, reviewed
    and others, are drawn by a hash and reach the driver as lists of features; a repeated row counts once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, seen, terms = docs.count(), None, np.empty(0, np.uint64)
    if labels is not None:
        told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        # bounded by fit_rows, so it may be broadcast
        seen = materialize(told.where(_share(F.xxhash64("doc_id"), fit_rows[0], told.count())), "quality-seen")
        texts = docs.join(F.broadcast(seen.where("toxic is not null")), "doc_id").select("text", (F.col("toxic") >= 1).alias("bad")).dropDuplicates()
        terms = learn_terms(texts.mapInArrow(_term_batches, "bad boolean, words array<long>, one long, two long"))
    votes = materialize(docs.mapInArrow(_vote_batches(False, terms), "doc_id long, votes array<int>"), "quality-votes")
    patterns = _with_reviews(votes, labels).groupBy(*TASKS).agg(F.count("*").alias("n")).collect()  # a row a pattern: at most 2^9 of the heuristics by 3^2 of the reviewers
    drawn = docs.where(_share(F.xxhash64("doc_id", "text"), fit_rows[1] if labels is not None else sum(fit_rows), total)).dropDuplicates()
    if seen is not None:
        drawn = drawn.unionByName(docs.join(F.broadcast(seen.select("doc_id")), "doc_id", "left_semi").dropDuplicates())
    rows = _with_reviews(drawn.mapInArrow(_vote_batches(True, terms), "doc_id long, votes array<int>, features array<int>"), labels).select("features", *TASKS).toPandas()
    if seen is not None:
        discard(seen)
    discard(votes)
    weights = []
    for task in TASKS:
        merged: dict[tuple, int] = {}
        for p in patterns:
            merged[tuple(p[task])] = merged.get(tuple(p[task]), 0) + p["n"]
        keys = sorted(merged)
        posterior, _, _ = fit_label_model(np.array(keys, dtype=np.int64).reshape(len(keys), len(LABELLERS[task])), np.array([merged[k] for k in keys], dtype=np.float64))
        by = dict(zip(keys, posterior))
        silent = np.array([not any(v) for v in rows[task]], dtype=bool)
        weight = np.where(silent & any(k[-1] for k in keys), SILENT_WEIGHT, 1.0)
        weights.append(fit_scorer(list(rows["features"]), np.array([by[tuple(v)] for v in rows[task]]), weight))
    return np.array(weights), terms


def classify(docs: DataFrame, labels: DataFrame | None = None, fit_rows: tuple[int, int] = FIT_ROWS, threshold: float = 0.4) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic and kept, which is false where either reaches ``threshold``.

    ``labels`` (doc_id, quality, toxic) adds the reviewers' votes; of repeated labels the worst counts. Null and empty
    texts have no words, on which all labellers abstain. Repeated rows are judged alike; null doc_ids have no reviews.
    Columns with one of the three names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("p_low_quality", "p_toxic", "kept")
    weights, terms = train(docs, labels, fit_rows)
    inner, names = numbered(docs, {})
    schema = T.StructType(list(inner.schema.fields))
    for t in TASKS:
        schema = schema.add(f"p_{t}", "double")
    out = inner.mapInArrow(_score_batches(weights, terms, names, names[docs.columns.index("text")]), schema).toDF(*docs.columns, *[f"p_{t}" for t in TASKS])
    return out.withColumn("kept", (F.col("p_low_quality") < threshold) & (F.col("p_toxic") < threshold))
