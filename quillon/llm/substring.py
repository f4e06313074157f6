"""Removal of repeated passages by compaction of a de Bruijn graph of words.

The edges of the graph are windows of ``size`` consecutive words. Consecutive windows that share a minimizer
(the least hash among the shorter runs of words inside) form a path without branches inside one document, and equal
windows always share it, so paths are grouped by their minimizer:

1. the first reading of the texts writes a slim table of paths, minimizer and source coordinate only; a minimizer
   that occurs once cannot be part of a repeat, and its path goes before anything wider is shuffled;
2. the source coordinates of the other paths are read again: the words there give a 128-bit BLAKE2 digest, by which
   paths count as equal, so minimizers that merely collide do no harm. Equal paths are compacted into one class,
   which keeps its earliest source coordinate;
3. classes that share a minimizer but differ are branches: they fall apart into single edges there, as do paths in which
   an edge occurs twice. Those edges are read from the earliest source and joined by the digest of their words to find
   each edge's earliest coordinate.

An edge is removable where its own coordinate (document, first word) is later than the earliest. Tables between
the steps are deleted when their successors are written. Hot minimizers (a passage that a third of all documents share)
combine before each shuffle of an aggregation, and joins on them have a side with one row for each key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, numbered
from quillon.llm.grams import SMALL, WORD_BASE, Words, ranges, slices

#: Words of a window, and words of the runs among which its minimizer is chosen.
SIZE, RUN = 20, 10
LAST = (1 << 63) - 1
SPANS = "anchor long, doc long, rev binary, start int, n int"
PATHS = "anchor long, one long, two long, doc long, rev binary, start int, n int, twice boolean"
EDGES = "anchor long, one long, two long, edge_one long, edge_two long, place int, doc long, rev binary, start int"
NEW = ("n_words", "n_removed", "kept_sha256")


def _paths(words: Words, size: int, run: int) -> tuple[np.ndarray, ...]:
    """(text, minimizer, first word in the text, edges) of the paths of a slice."""
    h = words.hashes()
    span = size - run + 1
    none = np.empty(0, np.int64)
    if len(h) < size:
        return none, none.astype(np.uint64), none, none
    every = np.arange(len(h) - run + 1)
    grams = ranges(h, WORD_BASE, every, every + run)
    text = words.owner()
    at = np.arange(len(h) - size + 1)
    at = at[at + size <= words.first[1:][text[: len(at)]]]
    if not len(at):
        return none, none.astype(np.uint64), none, none
    low = at + np.lib.stride_tricks.sliding_window_view(grams, span)[at].argmin(axis=1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    start = at[head]
    return text[start], grams[low[head]], start - words.first[text[start]], n


def _span_batches(size: int, run: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rev = batch.column("doc"), batch.column("rev")
            for words in slices(batch.column("text"), size=SMALL):
                text, anchor, start, n = _paths(words, size, run)
                if not len(text):
                    continue
                own = text + words.rows.start
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), doc.take(pa.array(own)), rev.take(pa.array(own)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                ], names=["anchor", "doc", "rev", "start", "n"])

    return made


def _digests(words: Words, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit digests of the runs of n words from word ``at`` on, two integers each."""
    text, where = words.spaced()
    raw = memoryview(text)
    digest = hashlib.blake2b
    made = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(where[at].tolist(), where[at + n].tolist())])
    return np.frombuffer(made, dtype=np.int64).reshape(-1, 2)


def _flat(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The items of a column of lists, and the row of each."""
    return column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())


def _path_batches(size: int):
    """The paths listed beside a text, each with the digest of its words and whether an edge occurs in it twice."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rev = batch.column("doc"), batch.column("rev")
            for words in slices(batch.column("text"), size=SMALL):
                flat, owner = _flat(batch.column("spans").slice(words.rows.start, len(words.first) - 1))
                anchor, start, n = (flat.field(c).to_numpy() for c in ("anchor", "start", "n"))
                at = words.first[owner] + start
                digest = _digests(words, at, n + size - 1)
                h = words.hashes()
                row = np.repeat(np.arange(len(n)), n)
                edge = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                edges = ranges(h, WORD_BASE, edge, edge + size)
                twice = np.zeros(len(n), dtype=bool)
                for far in range(1, int(n.max(initial=1))):
                    twice[row[far:][(edges[far:] == edges[:-far]) & (row[far:] == row[:-far])]] = True
                own = owner + words.rows.start
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor), pa.array(digest[:, 0]), pa.array(digest[:, 1]), doc.take(pa.array(own)), rev.take(pa.array(own)), pa.array(start), pa.array(n), pa.array(twice),
                ], names=["anchor", "one", "two", "doc", "rev", "start", "n", "twice"])

    return made


def _edge_batches(size: int):
    """Single edges of the paths listed beside a text, each with its place in the path and its source coordinate."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rev = batch.column("doc"), batch.column("rev")
            for words in slices(batch.column("text"), size=SMALL):
                flat, owner = _flat(batch.column("spans").slice(words.rows.start, len(words.first) - 1))
                n = flat.field("n").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = flat.field("start").to_numpy()[row] + place
                digest = _digests(words, words.first[owner[row]] + start, np.full(len(row), size))
                own = owner[row] + words.rows.start
                yield pa.RecordBatch.from_arrays([
                    *[pa.array(flat.field(c).to_numpy()[row]) for c in ("anchor", "one", "two")], pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                    pa.array(place.astype(np.int32)), doc.take(pa.array(own)), rev.take(pa.array(own)), pa.array(start.astype(np.int32)),
                ], names=["anchor", "one", "two", "edge_one", "edge_two", "place", "doc", "rev", "start"])

    return made


def _keys(doc_id, text) -> dict:
    """A text's identity: its id, and half of the SHA-256 of what it says, as ids may be null or repeated."""
    digest = F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)
    return {"doc": F.coalesce(doc_id.cast("long"), F.lit(LAST)), "rev": F.unhex(F.substring(digest, 1, 32)), "text": text}


def repeated_windows(docs: DataFrame, size: int = SIZE, run: int = RUN) -> DataFrame:
    """(doc, rev, spans of start and mask): edge start + i of a document repeats an earlier one where bit i of mask is set.

    ``doc`` is the doc_id (null: the largest integer), ``rev`` a 128-bit digest of the text, so documents that share an
    id, or have none, stay apart; rows equal in both are judged as one document. The result is a table in the shared folder.
    """
    texts = docs.select(*[c.alias(n) for n, c in _keys(F.col("doc_id"), F.col("text")).items()])
    slim = materialize(texts.mapInArrow(_span_batches(size, run), SPANS), "substring-spans")
    # two copies of one row are one document, so different coordinates must meet at the minimizer
    seen = slim.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    seen = materialize(seen, "substring-seen")
    listed = slim.join(seen, "anchor", "left_semi").groupBy("doc", "rev").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("spans"))
    listed = materialize(listed, "substring-listed")
    discard(slim, seen)
    repeated = materialize(texts.join(listed, ["doc", "rev"]).mapInArrow(_path_batches(size), PATHS), "substring-paths")
    discard(listed)
    key = ["anchor", "one", "two"]
    first = F.min(F.struct("doc", "rev", "start")).alias("f")
    classes = repeated.groupBy(*key).agg(first, F.first("n").alias("n"), F.max("twice").alias("twice"))
    classes = materialize(classes.select(*key, "f.doc", "f.rev", "f.start", "n", "twice"), "substring-classes")
    branching = classes.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("anchor")
    branches = classes.join(branching, "anchor", "left_semi").groupBy("doc", "rev").agg(F.collect_set(F.struct(*key, "start", "n")).alias("spans"))
    branches = materialize(branches, "substring-branches")
    edges = materialize(texts.join(branches, ["doc", "rev"]).mapInArrow(_edge_batches(size), EDGES), "substring-edges")
    coordinate = F.struct("doc", "rev", "start")
    earliest = edges.groupBy("anchor", "edge_one", "edge_two").agg(F.min(coordinate).alias("e"))
    later = edges.join(earliest, ["anchor", "edge_one", "edge_two"]).where(coordinate != F.col("e"))
    masks = later.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("first_mask"))
    known = classes.select(*key, F.col("doc").alias("_d"), F.col("rev").alias("_r"), F.col("start").alias("_s")).join(masks, key, "left")
    known = materialize(known, "substring-known")
    discard(edges, branches, classes)
    every = F.expr("shiftleft(1L, n) - 1")
    is_first = (F.col("doc") == F.col("_d")) & (F.col("rev") == F.col("_r")) & (F.col("start") == F.col("_s"))
    mask = F.when(is_first, F.coalesce("first_mask", F.lit(0).cast("long"))).otherwise(every)
    marked = repeated.join(known, key).select("doc", "rev", "start", mask.alias("mask")).where("mask <> 0")
    found = materialize(marked.groupBy("doc", "rev").agg(F.collect_set(F.struct("start", "mask")).alias("spans")), "substring-found")
    discard(repeated, known)
    return found


def _cut_batches(size: int, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), size=SMALL):
                out = {"n_words": words.lengths(), "n_removed": [], "kept_sha256": [], "text": []}
                spaced, where = words.spaced()
                flat, owner = _flat(batch.column("spans").slice(words.rows.start, len(words.first) - 1))
                gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
                start, mask = (flat.field(c).to_numpy() for c in ("start", "mask"))
                at = words.first[owner] + start
                for i in range(int(mask.max(initial=0)).bit_length()):
                    hit = at[(mask >> i) & 1 == 1] + i
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + size, -1)
                keep = np.cumsum(gone[:-1]) == 0
                removed = np.concatenate([[0], np.cumsum(~keep)])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
                data, spaced = words.data.tobytes(), spaced.tobytes()
                for t in range(len(words.first) - 1):
                    a, b = int(words.first[t]), int(words.first[t + 1])
                    lost = int(removed[b] - removed[a])
                    out["n_removed"].append(lost)
                    if not lost:
                        out["kept_sha256"].append(hashlib.sha256(spaced[where[a] : max(where[a], where[b] - 1)]).hexdigest())
                        out["text"].append(data[words.text_at[t] : words.text_at[t + 1]].decode("utf-8", "replace"))
                        continue
                    # kept runs of words, cut at the ends of this text
                    inner = edge[np.searchsorted(edge, a, side="right") : np.searchsorted(edge, b, side="left")].tolist()
                    runs = [*([a] if keep[a] else []), *inner, *([b] if keep[b - 1] else [])]
                    runs = list(zip(runs[::2], runs[1::2]))
                    out["kept_sha256"].append(hashlib.sha256(b" ".join([spaced[where[i] : where[j] - 1] for i, j in runs])).hexdigest())
                    out["text"].append(b" ".join([data[words.starts[i] : words.ends[j - 1]] for i, j in runs]).decode("utf-8", "replace"))
                rows = batch.slice(words.rows.start, words.rows.stop - words.rows.start)
                made = {"text": "text", **{c: c for c in NEW}}
                yield pa.RecordBatch.from_arrays([pa.array(out[made[f.name]], f.type) if f.name in made else rows.column(f.name).cast(f.type) for f in schema], schema=schema)

    return cut


def remove_repeats(docs: DataFrame, size: int = SIZE, run: int = RUN) -> DataFrame:
    """``docs`` without the words that a repeated window covers, with n_words, n_removed and kept_sha256.

    A window of ``size`` words is repeated if its words also start earlier, in a document of smaller doc_id
    or in the same one; windows are judged on the input. ``text`` keeps its white space between kept
    neighbours and has one space where words are gone; a text from which nothing goes is unchanged.
    kept_sha256 digests the kept words joined by one space. Null texts have no words and become empty; a null doc_id
    counts as the largest. Documents that share a doc_id, or have none, are ordered by a digest of their texts, and
    rows equal in both are judged as one document. An empty table gives an empty result. The caller's other columns stay
    as they are, whatever their names; only those called like one of the three results are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(*NEW)
    inner, names = numbered(docs, _keys(F.col("doc_id"), F.col("text")))
    place = docs.columns.index("text")
    found = repeated_windows(docs, size, run)
    joined = inner.drop(names[place]).join(found, ["doc", "rev"], "left").drop("doc", "rev")
    kept = [n for i, n in enumerate(names) if i != place]
    out = joined.select(*kept, F.coalesce("text", F.lit("")).alias("text")).schema
    out = out.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    cut = joined.mapInArrow(_cut_batches(size, to_arrow_schema(out)), out)
    return cut.select(*[F.col("text" if n == names[place] else n).alias(c) for n, c in zip(names, docs.columns)], *NEW)
