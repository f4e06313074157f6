"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is a run of five words (a shorter text is one shingle of all its words). Its weight is its count in
the document times an inverse document frequency, whose frequencies are counted over all different texts in a
fixed number of hashed buckets, so that copies of a text do not lower the weights of what it holds. A document's samples are drawn so that two documents share a sample with a
probability equal to their weighted Jaccard similarity; documents that share all samples of a band are
candidates, and the weighted Jaccard similarity of their texts decides.

Documents of equal words are folded into one representative first. In every bucket each member is compared with one
leader, the same one in all buckets that share members where possible, so the number of comparisons is linear in
the members. What leaders link is contracted, and buckets whose members are then still of several classes get other leaders, for
a few rounds. In a bucket of few members all pairs are compared. A larger one that still has several classes is compared
exactly (``_exact_pairs``): two weighted sets as similar as asked share one of their rarest shingles, so a join on those
finds every such pair, members of the largest class of a group left out among themselves. No bucket is capped or
dropped, and nothing but the weighted similarity of two whole texts decides. Texts that share only what is common make no
pairs there; a family whose pairs lie just below the similarity shares rare shingles too and makes pairs as the square
of its size, dealt out in cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, discard, materialize
from quillon.llm.grams import SMALL, WORD_BASE, Words, mix64, ranges, slices

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of samples: at a similarity of 0.8 a pair shares no band with probability 0.0002.
BANDS, ROWS = 12, 3
#: Ratio of the weights of two texts of one size class; most members on a side of a cell of the exact comparison.
GROWTH, CELL = 0.95, 64
#: Further rounds of leaders; most members of a bucket whose pairs are all compared; rarest shingles by which a pair is known to have met.
ROUNDS, FEW, MET = 3, 4, 16
#: Buckets of document frequencies; table of random draws per sample.
BUCKETS, DRAWS = 1 << 16, 1 << 14
SEED = 20240229


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles of a slice, repeats included."""
    h, n = words.hashes(), words.lengths()
    owner = words.owner()
    at = np.arange(len(h))
    ends = np.minimum(at + size, words.first[1:][owner]) if len(h) else at
    full = (at + size <= ends) | (at == words.first[:-1][owner]) & (n[owner] < size) if len(h) else np.empty(0, bool)
    at = at[full]
    return owner[at], ranges(h, WORD_BASE, at, ends[full])


def _weighted(words: Words, size: int, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), one line for each different shingle of a text, by text and shingle."""
    owner, h = _shingles(words, size)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(h))).astype(np.float64)
    owner, h = owner[head], h[head]
    return owner, h, count if idf is None else count * idf[(h >> np.uint64(48)).astype(np.int64) % len(idf)]


def _frequency_batches(size: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for words in slices(batch.column("text"), size=SMALL):
                _, h, _ = _weighted(words, size, None)
                total += np.bincount((h >> np.uint64(48)).astype(np.int64) % buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    return count


def inverse_frequencies(docs: DataFrame, size: int = SHINGLE, buckets: int = BUCKETS) -> np.ndarray:
    """A weight for each hashed bucket of shingles: 1 at the mean load or less, falling to 0.2 for frequent ones.

    Counts cover all rows given; what reaches the driver is one number a bucket, whatever the input.
    """
    rows = docs.select("text").mapInArrow(_frequency_batches(size, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(buckets)
    for bucket, count in rows:
        n[bucket] = count
    mean = max(1.0, n.sum() / buckets)
    return 1.0 / (1.0 + 0.5 * np.log(np.maximum(1.0, n / (2 * mean)))).clip(1.0, 5.0)


def _tables(samples: int) -> tuple[np.ndarray, ...]:
    """Per sample and draw: r ~ Gamma(2, 1), log c of c ~ Gamma(2, 1), and beta ~ U(0, 1)."""
    rng = np.random.default_rng(SEED)
    r = rng.gamma(2.0, 1.0, (samples, DRAWS))
    return r, np.log(rng.gamma(2.0, 1.0, (samples, DRAWS))), rng.random((samples, DRAWS))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the number of its words, and two hashes of all of them."""
    for batch in batches:
        for words in slices(batch.column("text"), size=SMALL):
            h = words.hashes()
            one, two = (ranges(x, WORD_BASE, words.first[:-1], words.first[1:]) for x in (h, mix64(h + np.uint64(99))))
            node = batch.column("node").slice(words.rows.start, len(words.first) - 1)
            arrays = [node, pa.array(words.lengths().astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "one", "two"])


def _sign_batches(size: int, samples: int, idf: np.ndarray):
    """The samples of each text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(samples)
        salts = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            for words in slices(batch.column("text"), size=SMALL):
                owner, h, weight = _weighted(words, size, idf)
                drawn = np.zeros((len(words.first) - 1, samples), dtype=np.int32)
                if len(h):
                    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    lengths = np.diff(np.append(head, len(h)))
                    logw = np.log(weight)
                    for k in range(samples):
                        at = ((h ^ salts[k]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50)).astype(np.int64)
                        r, logc, beta = (t[k][at] for t in tables)
                        level = np.floor(logw / r + beta)
                        value = logc - r * (level - beta) - r
                        is_low = value == np.repeat(np.minimum.reduceat(value, head), lengths)
                        tied = np.where(is_low, mix64(h + level.astype(np.int64).view(np.uint64)), np.uint64(0xFFFFFFFFFFFFFFFF))
                        drawn[owner[head], k] = (np.minimum.reduceat(tied, head) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * samples), pa.array(drawn.ravel()))
                node = batch.column("node").slice(words.rows.start, len(drawn))
                yield pa.RecordBatch.from_arrays([node, flat], names=["node", "samples"])

    return sign


def _verify_batches(size: int, similarity: float, idf: np.ndarray):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for words in slices(column, size=SMALL):
                owner, h, weight = _weighted(words, size, idf)
                cut = np.searchsorted(owner, np.arange(len(words.first)))
                out += [(h[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:])]
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                passed = []
                for (h, w), (g, v) in zip(vectors(batch.column("text_a")), vectors(batch.column("text_b"))):
                    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                    low = np.minimum(w[i], v[j]).sum()
                    passed.append(bool(low >= similarity * (w.sum() + v.sum() - low) - 1e-9))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(passed, pa.bool_())], names=["a", "b", "linked"])

    return verify


def _shingle_batches(size: int, idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), size=SMALL):
                owner, h, weight = _weighted(words, size, idf)
                node = batch.column("node").slice(words.rows.start, len(words.first) - 1).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([node, pa.array(h.view(np.int64)), pa.array(weight)], names=["node", "h", "w"])

    return rows


def _prefix_batches(similarity: float):
    """Keys (base, step, h) of the rarest shingles of each text, for a partner in each size class that is near enough.

    A pair is as similar as asked only if its shared weight is ``similarity / (1 + similarity)`` of both weights. Leave
    out, from the most frequent shingle on, less weight than that: the rest of the two texts, in the same order, must meet.
    The least weight of a partner follows from its size class; ``rest`` is the weight from this shingle on. ``before`` has the first
    ``MET`` shingles in front of this one: two texts that share one of them have met there.
    """
    width, share = -np.log(GROWTH), similarity / (1 + similarity)
    steps = int(-np.log(similarity) / width) + 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, met = [], []
            for node, root, s in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), batch.column("shingles")):
                n, h, w = (s.values.field(k).to_numpy() for k in ("n", "h", "w"))
                rest = w[::-1].cumsum()[::-1]
                total = rest[0]
                own = int(np.floor(np.log(total) / width))
                for step in range(steps + 1):
                    for large in (False, True):
                        if step == 0 and not large:
                            continue  # in one class either may be the larger: the bound of the larger holds for both
                        base = own - step if large else own
                        other = max(similarity * total, np.exp(width * base)) if large else max(total, np.exp(width * (own + step)))
                        at = np.flatnonzero((rest >= share * (total + other) * (1 - 1e-9)) & (n > 1))
                        made.append((node, root, base, step, large, total, h[at], rest[at]))
                        met += [h[at[:k]] for k in range(min(len(at), MET))] + [h[at[:MET]]] * max(0, len(at) - MET)
            counts = [len(m[6]) for m in made]
            column = lambda k, t: pa.array(np.repeat(np.array([m[k] for m in made], dtype=t), counts))
            join = lambda k, t: pa.array(np.concatenate([m[k] for m in made] or [np.empty(0, t)]).astype(t))
            arrays = [column(0, np.int64), column(1, np.int64), column(2, np.int32), column(3, np.int32), column(4, bool), column(5, np.float64), join(6, np.int64), join(7, np.float64)]
            ends = np.cumsum([0] + [len(m) for m in met]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(met or [np.empty(0, np.int64)]).astype(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "root", "base", "step", "large", "total", "h", "rest", "before"])

    return keys


def _exact_pairs(texts: DataFrame, roots: DataFrame, similarity: float, size: int, idf: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of ``texts`` (node, text) of different classes, among which is every pair as similar as asked; and the tables behind them.

    A key's members of its largest class are not compared with one another, nor are keys of one class; larger
    groups are dealt out in cells, so that no task holds a whole one.
    """
    shingles = texts.mapInArrow(_shingle_batches(size, idf), "node long, h long, w double").groupBy("node", "h").agg(F.max("w").alias("w"))
    shingles = materialize(shingles, "neardup-shingles")
    often = materialize(shingles.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "neardup-often")
    ordered = shingles.join(often, "h", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "h", "w"))).alias("shingles"))
    ordered = ordered.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "shingles")
    keys = materialize(
        ordered.mapInArrow(_prefix_batches(similarity), "node long, root long, base int, step int, large boolean, total double, h long, rest double, before array<long>"), "neardup-prefixes"
    )
    discard(shingles, often)
    key = ["base", "step", "h"]
    by_root = keys.groupBy(*key, "root").agg(F.count("*").alias("n"))
    groups = by_root.groupBy(*key).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    groups = groups.where("n > top.n").select(*key, F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / CELL).alias("p"), F.ceil(F.col("n") / CELL).alias("q"))
    groups = materialize(groups, "neardup-groups")
    members = keys.join(groups, key)
    dealt = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    copies = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    one = members.where("root <> top").withColumn("i", dealt("p")).withColumn("j", copies("q")).drop("p", "q", "top")
    two = members.withColumn("j", dealt("q")).withColumn("i", copies("p")).drop("p", "q")
    two = two.withColumnsRenamed({c: f"{c}_2" for c in ("node", "root", "large", "total", "rest", "before")})
    pairs = one.join(two, [*key, "i", "j"]).where(
        (F.col("root") != F.col("root_2")) & ((F.col("step") == 0) | (F.col("large") != F.col("large_2"))) & ((F.col("root_2") == F.col("top")) | (F.col("node") < F.col("node_2")))
    )
    pairs = pairs.where(F.least("rest", "rest_2") >= (F.col("total") + F.col("total_2")) * F.lit(similarity / (1 + similarity) * (1 - 1e-9)))
    # similar texts share most of their rarest shingles: only the first of these makes the pair
    pairs = pairs.where(~F.arrays_overlap("before", "before_2"))
    return pairs.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct(), [keys, groups]


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float, idf: np.ndarray, name: str) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked, as a table; of several texts of an id any may be.

    ``texts`` is bucketed by its node: what moves is one text of each pair.
    """
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verify_batches(size, similarity, idf), "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), name)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (node, root) after further links: these join whole classes, so only roots take part in it."""
    of = roots.toDF("a", "root_a")
    ends = links.join(of, "a", "left").join(roots.toDF("b", "root_b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected_components(ends)
    new = joined.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti")
    every = roots.unionByName(new).join(joined.toDF("root", "above"), "root", "left")
    merged = materialize(every.select("node", F.coalesce("above", "root").alias("root")), "neardup-roots")
    discard(roots, joined)
    return merged


def _further_links(members: DataFrame, roots: DataFrame, verified) -> DataFrame:
    """Roots after other leaders of the buckets (band, key, node, n, lead) that have members of several classes, and after all pairs of small buckets.

    A round compares each member with at most one other of its bucket. A bucket of two has been compared whole by its first leader.
    """
    key, pair = ["band", "key"], (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    larger = members.where("n > 2")
    for k in range(1, ROUNDS + 1):
        of = larger.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        leads = of.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(k))).alias("l"))
        leads = leads.where("lo <> hi").select(*key, F.col("l.node").alias("other"), F.col("l.root").alias("other_root"))
        links = verified(of.join(leads, key).where("root <> other_root").select(*pair).distinct(), f"neardup-links-{k}")
        if links.isEmpty():
            discard(links)
            break
        roots = _merged(roots, links)
        discard(links)
    few = larger.where((F.col("n") <= FEW) & (F.col("node") != F.col("lead"))).join(roots, "node", "left").select(*key, "node", F.coalesce("root", "node").alias("root"))
    pairs = few.join(few.toDF(*key, "other", "other_root"), key).where("node < other and root <> other_root").select(*pair).distinct()
    links = verified(pairs, "neardup-few-links")
    if not links.isEmpty():
        roots = _merged(roots, links)
    discard(links)
    return roots


def near_duplicate_classes(
    docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, class_id): documents of one class are linked by weighted Jaccard similarity >= ``similarity``.

    One row a document; class_id is the least doc_id of the class. Texts of equal words are always of one class; texts
    without words (null, empty, white space) form classes of their own, a document each. A null doc_id has a null class.
    Repeated rows stay repeated and share a class; different texts of one doc_id count as one document. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    known = docs.where("node is not null")
    prints = materialize(known.mapInArrow(_print_batches, "node long, n long, one long, two long"), "neardup-prints")
    least = prints.where("n > 0").groupBy("n", "one", "two").agg(F.min("node").alias("rep"))
    folded = materialize(prints.join(least, ["n", "one", "two"], "left").select("node", F.coalesce("rep", "node").alias("rep"), "n"), "neardup-folded")
    reps = folded.where("n > 0 and node = rep").select("node").distinct()
    each = known.join(reps, "node", "left_semi").groupBy("node", F.xxhash64("text").alias("rev")).agg(F.first("text").alias("text"))
    different = materialize(each.select("node", "text"), "neardup-different", key="node")
    discard(prints)
    idf = inverse_frequencies(different, size)
    samples = different.mapInArrow(_sign_batches(size, bands * rows, idf), "node long, samples array<int>")
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("samples")[k] for k in range(b * rows, (b + 1) * rows)]) for b in range(bands)])
    banded = materialize(samples.select("node", F.posexplode(keys).alias("band", "key")), "neardup-bands")
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("lead")).where("n > 1")
    members = materialize(banded.join(shared, ["band", "key"]), "neardup-members")
    texts = materialize(different.join(members.select("node").distinct(), "node", "left_semi"), "neardup-texts", key="node")
    discard(banded, different)
    pairs = members.where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = _verified(pairs, texts, size, similarity, idf, "neardup-links")
    roots = connected_components(links)
    discard(links)
    roots = _further_links(members, roots, lambda pairs, name: _verified(pairs, texts, size, similarity, idf, name))
    # larger buckets whose members are of several classes
    tagged = members.where(F.col("n") > FEW).select("band", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = tagged.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key")
    left = materialize(tagged.join(mixed, ["band", "key"], "left_semi").select("node").distinct(), "neardup-left")
    discard(members)
    if not left.isEmpty():
        pairs, spent = _exact_pairs(texts.join(left, "node", "left_semi"), roots, similarity, size, idf)
        more = _verified(pairs, texts, size, similarity, idf, "neardup-more-links")
        discard(*spent)
        if not more.isEmpty():
            roots = _merged(roots, more)
        discard(more)
    discard(texts, left)
    found = folded.join(roots.toDF("rep", "root"), "rep", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"))
    return found.unionByName(docs.where("node is null").select(F.col("node").alias("doc_id"), F.col("node").alias("class_id")))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the one of least doc_id. Rows without a doc_id all stay.

    Rows that repeat a kept doc_id all stay, as they are one document.
    """
    classes = near_duplicate_classes(docs, **options)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
