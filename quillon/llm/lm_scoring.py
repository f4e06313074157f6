"""Language-model scoring with causal self-attention over subword ids.

Texts are words (ASCII-lower-cased) and an end; a word is cut into pieces of a public vocabulary.
Three things are learnt from all training documents:

* the counts of all words, kept as a table and joined when texts are scored;
* the counts of all pairs of neighbouring pieces, summed to (piece, class of the next piece);
* a causal self-attention layer, trained in numpy. It reads the pieces of up to two blocks before and adds to
  the class scores what the wider context says. A round of descent takes its part of the training documents, and each document
  is in one round. Every task descends over all places of its texts, from the parameters all tasks start the round with; the
  results are averaged by their numbers of places.

The model predicts a class for the next piece, then the piece inside its class; a word's probability is the product
over its pieces, mixed with its share among the words counted. A training document is scored by what the *other*
documents say: its own words are taken out of the counts it is mixed with. So training and held-out documents
compare, and a text that also occurs elsewhere stands out.

Scoring lays a text out in blocks; each block attends, masked, to itself and the block before it, so windows overlap
and every piece is scored once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.grams import Words, slices

#: Classes, width of the embeddings, positions of a block (a window is two blocks).
CLASSES, WIDTH, BLOCK = 32, 16, 16
#: Windows of a step of descent and of a run, whose windows share their blocks; least steps of a task in a round, rates of descent by round.
BATCH, RUN, LEAST_STEPS, RATES = 96, 4, 100, (0.002, 0.001, 0.0004)
#: The layer's parameters that descent moves.
LEARNT = ("b", "o", "q")
#: Weight of the attention model in a word's probability; the rest is the word's share among all words counted.
MODEL_WEIGHT = 0.6
#: Most words whose counts are sent to every task; counts of all others are joined.
FREQUENT = 1 << 17
TOKEN, PAIR = 0, 1
#: Most words a process remembers the pieces of.
REMEMBERED = 1 << 18
#: Bytes of a slice of texts that are counted or scored, so that most of it stays in a core's cache.
SLICE = 1 << 19


_ENCODINGS: dict[bytes, tuple] = {}


class Cuts:
    """The pieces of words met before, so that a word that comes back in other texts is not merged again: sorted hashes of words, and where the pieces of each are in ``flat``."""

    def __init__(self):
        self.hashes, self.begin, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted hashes, whether each is there, and where."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return (self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)), at

    def add(self, hashes: np.ndarray, n: np.ndarray, pieces: np.ndarray) -> None:
        """Remember further words (their numbers of pieces, all pieces), as long as there is room."""
        if not len(hashes) or len(self.hashes) + len(hashes) > REMEMBERED or len(self.flat) + len(pieces) > 8 * REMEMBERED:
            return
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.hashes, self.begin, self.n, self.flat = every[order], begin[order], np.concatenate([self.n, n])[order], np.concatenate([self.flat, pieces])


class Subwords:
    """Pieces of words by a public byte-level vocabulary: each word with a space before it is cut by byte-pair merging."""

    def __init__(self, ranks: bytes):
        self.ranks = ranks
        if ranks not in _ENCODINGS:  # one a process, whatever the number of tasks
            import tiktoken

            table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks.splitlines())}
            begins = np.zeros(max(table.values()) + 1, dtype=bool)
            begins[[rank for piece, rank in table.items() if piece.startswith(b" ")]] = True
            _ENCODINGS[ranks] = (tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=table, special_tokens={}), begins, Cuts())
        self.encoding, self.begins, self.cuts = _ENCODINGS[ranks]
        self.end = len(self.begins)

    def __reduce__(self):
        return Subwords, (self.ranks,)

    @property
    def size(self) -> int:
        return self.end + 1

    @staticmethod
    def load(path: str) -> Subwords:
        """Read a file of ranks on the driver; tasks get its bytes, which are of fixed size."""
        with open(path, "rb") as f:
            return Subwords(f.read())

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words, and how many each has. Only a word's first piece begins with the space."""
        return self.cut_said(b"".join([b" " + w for w in words]))

    def cut_said(self, said: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As ``cut``, of words in one string, each after a space."""
        ids = self.encoding.encode_to_numpy(said.decode("utf-8", "replace"), disallowed_special=()).astype(np.int32)
        first = np.flatnonzero(self.begins[ids])
        return ids, np.diff(np.append(first, len(ids)))

    def cut_distinct(self, words: Words, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, and for each of some words (``first``, by sorted hash) where its pieces begin among them and how many it has."""
        known, at = self.cuts.known(hashes)
        new = np.flatnonzero(~known)
        lengths = words.ends[first[new]] - words.starts[first[new]] + 1  # a space before each
        upto = np.cumsum(lengths)
        said = words.data[np.maximum(np.repeat(words.starts[first[new]] - 1 - (upto - lengths), lengths) + np.arange(lengths.sum()), 0)]
        said[upto - lengths] = 32
        ids, n = self.cut_said(said.tobytes())
        pieces = np.concatenate([self.cuts.flat, ids])
        begin, many = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        begin[known], many[known] = self.cuts.begin[at[known]], self.cuts.n[at[known]]
        begin[new], many[new] = len(self.cuts.flat) + np.cumsum(n) - n, n
        self.cuts.add(hashes[new], n, ids)
        return pieces, begin, many


@dataclass
class Stream:
    """The pieces of some texts, each text after an end and followed by one.

    Text t is x[begin[t]:begin[t + 1]]; word w of the slice is ``pieces[w]`` pieces long, and ``distinct[place[w]]`` is the word's hash.
    """

    x: np.ndarray
    begin: np.ndarray
    pieces: np.ndarray
    distinct: np.ndarray
    place: np.ndarray
    counts: np.ndarray

    @property
    def inside(self) -> np.ndarray:
        """The places of words' pieces."""
        is_piece = np.ones(len(self.x), dtype=bool)
        is_piece[self.begin[:-1]] = False
        is_piece[self.begin[1:] - 1] = False
        return np.flatnonzero(is_piece)


def stream(subwords: Subwords, words: Words) -> Stream:
    distinct, first, place, counts = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
    pieces, at, lengths = subwords.cut_distinct(words, distinct, first)
    n = lengths[place]
    # an end is a word of one piece, before and after each text
    said = np.arange(len(place)) + 2 * words.owner() + 1
    per, source = np.ones(len(place) + 2 * len(words.lengths()), np.int32), np.full(len(place) + 2 * len(words.lengths()), len(pieces), np.int32)
    per[said], source[said] = n, at[place]
    upto = np.concatenate([[0], np.cumsum(per)])
    begin = upto[words.first + 2 * np.arange(len(words.first))]
    x = np.append(pieces, np.int32(subwords.end)).take(np.repeat((source - upto[:-1]).astype(np.int32), per) + np.arange(upto[-1], dtype=np.int32))
    return Stream(x, begin, n, distinct, place, counts)


def powers_of(x: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the entries of ``x``, in place, their sum in each row, and what was taken off the rows before.

    ``sure`` has entries of ``x``, one that counts for each row. A row's greatest entry is taken off only where powers could overflow or vanish.
    """
    top = np.zeros((*x.shape[:-1], 1), dtype=x.dtype)
    if len(sure) and (x.max() > 60 or sure.min() < -60):
        top = x.max(axis=-1, keepdims=True)
        x -= top
    np.exp(x, out=x)
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], dtype=x.dtype)).reshape(x.shape[:-1]), top[..., 0]


def _with_before(blocks: np.ndarray) -> np.ndarray:
    """For blocks (..., blocks, places, width) each but the first with the one before it, as a view that copies nothing."""
    *outer, n, places, width = blocks.shape
    *steps, block, place, one = blocks.strides
    return np.lib.stride_tricks.as_strided(blocks, (*outer, n - 1, 2 * places, width), (*steps, block, place, one), writeable=False)


CAUSAL = np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK
_OWN = np.arange(BLOCK)
_DISTANCE = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0, 2 * BLOCK - 1)


@dataclass
class Model:
    """The attention model: tables over pieces and classes, all of fixed size, and the layer's parameters.

    ``p``: projections q, k, v, the output o, and b, the weight of each distance. The layer only ever sees q kᵀ and v o. As a head is as wide as
    an embedding, these take every value whatever invertible k and v are; so k and v stay as they are, and q, o and b are learnt.
    """

    classes: np.ndarray  # class of each piece
    next_class: np.ndarray  # log P(next class | piece) before attention
    in_class: np.ndarray  # log P(piece | its class)
    embed: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Natural log probability of the piece after each place of a stream; 0 after the last place of a text."""
        n = np.diff(begin) - 1
        per = -(-n // BLOCK)
        at = np.full(int(per.sum()) * BLOCK, -1, dtype=np.int64)
        text_at = (np.cumsum(per) - per) * BLOCK
        steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at[np.repeat(text_at, n) + steps] = np.repeat(begin[:-1], n) + steps
        at = at.reshape(-1, BLOCK)
        goes_on = np.ones(len(at), dtype=bool)
        goes_on[text_at // BLOCK] = False
        # k is folded into the queries and v into the output, so a piece's key and its value are its embedding
        query = self.embed @ (self.p["q"] @ self.p["k"].T / np.sqrt(np.float32(WIDTH)))
        out = self.p["v"] @ self.p["o"]
        bias = np.where(CAUSAL, self.p["b"][_DISTANCE], np.float32(-1e9)).astype(np.float32)
        total = np.zeros(len(x), dtype=np.float32)
        step = 96  # what a step holds stays in a core's cache
        for lo in range(0, len(at), step):
            hi = min(len(at), lo + step)
            ids = x[np.maximum(at[lo - 1 : hi] if lo else np.concatenate([at[:1], at[:hi]]), 0)]
            both = _with_before(np.take(self.embed, ids, axis=0))
            scores = np.take(query, ids[1:], axis=0) @ both.transpose(0, 2, 1)
            scores += bias
            scores[~goes_on[lo:hi], :, :BLOCK] = -1e9
            sums, _ = powers_of(scores, scores[:, _OWN, _OWN + BLOCK])
            context = scores @ both
            context /= sums[:, :, None]
            real = at[lo:hi] >= 0
            here = at[lo:hi][real]
            logits = context[real] @ out
            logits += np.take(self.next_class, x[here], axis=0)
            following = x[here + 1]
            wanted = logits.take(np.arange(len(here)) * CLASSES + self.classes[following])
            sums, top = powers_of(logits, wanted)
            total[here] = wanted - top - np.log(sums) + self.in_class[following]
        return total


def choose_classes(counts: np.ndarray) -> np.ndarray:
    """A class for each piece: the most frequent ones alone, the others shared out evenly by falling frequency."""
    order = np.argsort(-counts, kind="stable")
    alone = CLASSES * 3 // 4
    classes = np.empty(len(counts), dtype=np.int64)
    classes[order[:alone]] = np.arange(alone)
    mass = np.cumsum(counts[order[alone:]] + 1e-3)
    classes[order[alone:]] = alone + np.minimum(CLASSES - alone - 1, (mass / mass[-1] * (CLASSES - alone)).astype(np.int64))
    return classes


def start(classes: np.ndarray, piece_n: np.ndarray, to_class: np.ndarray) -> Model:
    """The model from counts (pieces; piece x class of the next) before any descent: attention adds nothing yet.

    Smoothing falls back from piece to class of the piece to all pieces. Embeddings are singular vectors of the table.
    At first a place attends by distance alone, so all tasks set out in the same direction.
    """
    one_hot = np.zeros((CLASSES, len(classes)), dtype=np.float32)
    one_hot[classes, np.arange(len(classes))] = 1
    overall = to_class.sum(0) + 1.0
    overall /= overall.sum()
    by_class = one_hot @ to_class
    by_class = (by_class + 20 * overall) / (by_class.sum(1, keepdims=True) + 20)
    seen = to_class.sum(1, keepdims=True)
    next_class = np.log((to_class + 20 * by_class[classes]) / (seen + 20)).astype(np.float32)
    piece = piece_n + 0.5
    in_class = np.log(piece / np.bincount(classes, weights=piece, minlength=CLASSES)[classes]).astype(np.float32)
    # embeddings: directions in which pieces differ in what follows them
    surprise = (next_class - np.log(overall)) * np.sqrt(seen / (seen + 50))
    u, _, _ = np.linalg.svd(surprise.T @ surprise)
    embed = surprise @ u[:, :WIDTH]
    embed = (embed / (embed.std(axis=0, keepdims=True) + 1e-6)).astype(np.float32)
    p = {"q": np.zeros((WIDTH, WIDTH), np.float32), "k": np.eye(WIDTH, dtype=np.float32), "v": np.eye(WIDTH, dtype=np.float32)}
    p["o"], p["b"] = np.zeros((WIDTH, CLASSES), np.float32), np.linspace(0.5, -0.5, 2 * BLOCK).astype(np.float32)
    return Model(classes, next_class, in_class, embed, p)


def gradients(m: Model, runs: np.ndarray, n: np.ndarray, places: np.ndarray | None = None, opens: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean class loss of the second halves of the windows of some runs, of which the first ``n`` windows count.

    A run is some blocks and the piece after them; each of its windows is a block that is judged and the one before it. Where ``places`` is given,
    only so many first places of a run's windows count; where ``opens`` is true, the run's first block lies before the text and is not attended to.
    """
    p, (r, width) = m.p, runs.shape
    windows = width // BLOCK - 1
    to_query, out = p["k"].T * np.float32(1 / np.sqrt(WIDTH)), p["v"] @ p["o"]
    e = np.take(m.embed, runs[:, :-1], axis=0).reshape(r, windows + 1, BLOCK, WIDTH)
    both, own = _with_before(e), e[:, 1:].reshape(-1, WIDTH)
    a = (own @ (p["q"] @ to_query)).reshape(r, windows, BLOCK, WIDTH) @ both.swapaxes(2, 3)
    a += np.where(CAUSAL, p["b"][_DISTANCE], np.float32(-1e9))
    if opens is not None:
        a[opens, 0, :, :BLOCK] = -1e9
    mass, _ = powers_of(a, a[:, :, _OWN, _OWN + BLOCK])  # the weights of attention are a / mass
    mass = mass.reshape(-1, 1)
    context = (a @ both).reshape(-1, WIDTH)
    context /= mass
    prob = np.take(m.next_class, runs[:, BLOCK:-1].ravel(), axis=0)
    prob += context @ out
    wanted = np.arange(len(prob)) * CLASSES + m.classes[runs[:, BLOCK + 1 :].ravel()]
    sums, _ = powers_of(prob, prob.take(wanted))
    places = n * BLOCK if places is None else places
    share = ((np.arange(windows * BLOCK) < places[:, None]).ravel() / np.float32(places.sum())).astype(np.float32)
    prob *= (share / sums)[:, None]
    prob.reshape(-1)[wanted] -= share
    d_context = prob @ out.T
    d_context /= mass
    d_scores = d_context.reshape(r, windows, BLOCK, WIDTH) @ both.swapaxes(2, 3)
    d_scores -= np.einsum("ij,ij->i", d_context, context).reshape(r, windows, BLOCK, 1)
    d_scores *= a
    return {
        "o": p["v"].T @ (context.T @ prob),
        "q": own.T @ (d_scores @ both).reshape(-1, WIDTH) @ to_query.T,
        "b": np.bincount(_DISTANCE.ravel(), weights=d_scores.sum((0, 1)).ravel(), minlength=2 * BLOCK).astype(np.float32),
    }


def flattened(p: dict[str, np.ndarray]) -> np.ndarray:
    """The parameters that are learnt, in one row."""
    return np.concatenate([p[c].ravel() for c in LEARNT])


def shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All parameters, those that are learnt as views of a row."""
    ends = np.cumsum([like[c].size for c in LEARNT])
    return like | {c: part.reshape(like[c].shape) for c, part in zip(LEARNT, np.split(flat, ends[:-1]))}


def descend(m: Model, batches: Iterator[tuple[np.ndarray, ...]], rate: float) -> Model:
    """The model after Adam's descent over batches of runs, each with what ``gradients`` takes beside them."""
    flat = flattened(m.p).astype(np.float32)
    now = replace(m, p=shaped(flat, m.p))  # views: a step changes them in place
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    for t, batch in enumerate(batches, 1):
        g = flattened(gradients(now, *batch))
        m1 += np.float32(0.1) * (g - m1)
        m2 += np.float32(0.01) * (g * g - m2)
        flat -= np.float32(rate / (1 - 0.9**t)) * m1 / (np.sqrt(m2 * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
    return now


def runs_of(s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """The runs of every text that has a whole window, and the windows of each: all windows of two blocks with the piece after them, neighbours overlapping by half.

    The other places of texts are in ``margins_of``. Each window is in one run. A text's last run may have fewer windows than others; pieces that it lacks are the text's last.
    """
    windows = np.maximum(0, (np.diff(s.begin) - 2 * BLOCK - 1) // BLOCK + 1)
    per = -(-windows // RUN)
    nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    at = np.repeat(s.begin[:-1], per)[:, None] + RUN * BLOCK * nth[:, None] + np.arange((RUN + 1) * BLOCK + 1)
    return s.x[np.minimum(at, np.repeat(s.begin[1:] - 1, per)[:, None])], np.minimum(RUN, np.repeat(windows, per) - RUN * nth)


def margins_of(s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``runs_of`` does not judge, as runs of one window, their numbers of windows, of places, and whether they open a text.

    That is each text's first block, which has no block before it, and the places after its last whole block. So with ``runs_of`` each place that has
    a piece after it is judged once, also in texts of less than a window. Pieces that a run lacks are the text's last, or, before the text, its first.
    """
    n = np.diff(s.begin) - 1
    closing = np.flatnonzero((n > BLOCK) & (n % BLOCK > 0))
    text = np.concatenate([np.arange(len(n)), closing])
    at = np.concatenate([s.begin[:-1] - BLOCK, s.begin[closing] + (n[closing] // BLOCK - 1) * BLOCK])
    at = np.clip(at[:, None] + np.arange(2 * BLOCK + 1), s.begin[text][:, None], s.begin[text + 1][:, None] - 1)
    return s.x[at], np.ones(len(text), np.int64), np.concatenate([np.minimum(n, BLOCK), n[closing] % BLOCK]), np.arange(len(text)) < len(n)


def _descend_batches(subwords: Subwords, shared, rate: float, seed: int):
    """A task's descent over all places of its texts, shuffled a slice of texts at a time: each parameter's sum, weighted by the number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        seen = 0

        def order() -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal seen
            steps, dealt = 0, []
            for batch in batches:
                for words in slices(batch.column("text"), lower=True):
                    s = stream(subwords, words)
                    seen += len(s.x) - len(words.lengths())
                    dealt = []
                    for kind, step in ((runs_of(s), BATCH // RUN), (margins_of(s), BATCH)):
                        mixed = rng.permutation(len(kind[0]))
                        dealt += [(kind, mixed[at : at + step]) for at in range(0, len(mixed), step)]
                    for k in rng.permutation(len(dealt)):
                        kind, some = dealt[k]
                        steps += 1
                        yield tuple(part[some] for part in kind)
            while dealt and steps < LEAST_STEPS:  # a task with few windows passes over them again
                kind, some = dealt[rng.integers(0, len(dealt))]
                steps += 1
                again = rng.integers(0, len(kind[0]), len(some))
                yield tuple(part[again] for part in kind)

        flat = flattened(descend(shared.value, order(), rate).p).astype(np.float64)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], names=["at", "v", "n"])

    return run


def rounds(texts: DataFrame, passes: int, rates: tuple[float, ...]) -> Iterator[tuple[float, DataFrame]]:
    """(rate, texts) of each round of descent: a pass deals the texts (doc_id, text) to one round of each rate by a hash, so each is met once a pass."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(len(rates)))
    for i, rate in enumerate(rates):
        for j in range(passes):
            yield rate, texts.where(part == (i + j) % len(rates))


def train(texts: DataFrame, subwords: Subwords, model: Model, passes: int = 1, rates: tuple[float, ...] = RATES) -> Model:
    """The model after ``passes`` passes over all places of ``texts`` (doc_id, text). One row a parameter reaches the driver in each round."""
    for k, (rate, some) in enumerate(rounds(texts, passes, rates)):
        shared = texts.sparkSession.sparkContext.broadcast(model)
        rows = some.select("text").mapInArrow(_descend_batches(subwords, shared, rate, k), "at int, v double, n long")
        got = rows.groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("at").toPandas()
        shared.unpersist()
        if not len(got):
            continue
        model = replace(model, p=shaped(got["v"].to_numpy(dtype=np.float32), model.p))
    return model


def _count_batches(subwords: Subwords):
    """Counts of a task's training texts: of words by hash, and of pairs of neighbouring pieces."""
    size = subwords.size

    def rows(kind: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {TOKEN: [], PAIR: []}
        waiting = 0
        for batch in batches:
            for words in slices(batch.column("text"), lower=True, size=SLICE):
                s = stream(subwords, words)
                ok = np.ones(len(s.x), dtype=bool)
                ok[s.begin[1:] - 1] = False  # no pair across two texts
                at = np.flatnonzero(ok)
                held[TOKEN].append((s.distinct, s.counts))
                held[PAIR].append(np.unique(s.x[at].astype(np.int64) * size + s.x[at + 1], return_counts=True))
                waiting += len(s.distinct)
                if waiting > 1_500_000:
                    yield from (rows(kind, got) for kind, got in held.items())
                    held, waiting = {TOKEN: [], PAIR: []}, 0
        if held[TOKEN]:
            yield from (rows(kind, got) for kind, got in held.items())

    return count


COLUMNS = ["doc_id", "rev", "train", "key", "n", "n_known", "base", "score"]
SCORED = "doc_id long, rev long, train boolean, key long, n long, n_known long, base double, score double"


def _score_batches(subwords: Subwords, shared, frequent, log_total: float):
    """Per text a row with what its frequent words give (key null), and a row for each place of another word.

    Such a row has in n how often the text has the word, in score the model's log10 probability.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        hashes, counts, smoothed = frequent.value  # sorted hashes of frequent words, their counts and log10 of their smoothed share
        for batch in batches:
            for words in slices(batch.column("text"), lower=True, size=SLICE):
                texts = len(words.first) - 1
                doc, rev, train = (batch.column(c).slice(words.rows.start, texts) for c in ("doc_id", "rev", "train"))
                s = stream(subwords, words)
                total = model.score(s.x, s.begin) / np.float32(np.log(10))
                begins, inside = np.cumsum(s.pieces) - s.pieces, s.inside
                said = np.add.reduceat(total[inside - 1], begins) if len(begins) else np.empty(0)
                end = total[s.begin[1:] - 2].astype(np.float64)
                owner, kinds = words.owner(), max(1, len(s.distinct))
                _, pair, repeats = np.unique(owner * kinds + s.place, return_inverse=True, return_counts=True)
                own = repeats[pair]  # how often the text has the word
                at = np.minimum(np.searchsorted(hashes, s.distinct), max(0, len(hashes) - 1))
                known = hashes[at] == s.distinct if len(hashes) else np.zeros(len(s.distinct), dtype=bool)
                local = known[s.place]
                word = at[s.place[local]]
                others = counts[word] - own[local] * train.to_numpy(zero_copy_only=False)[owner[local]]
                mixed = mixture(said[local].astype(np.float64), others, log_total)
                sums = lambda v: np.bincount(owner[local], weights=v, minlength=texts).astype(np.float64)
                yield pa.RecordBatch.from_arrays([
                    doc, rev, train, pa.nulls(texts, pa.int64()), pa.array(words.lengths().astype(np.int64)), pa.array(np.bincount(owner[local], minlength=texts).astype(np.int64)),
                    pa.array(sums(smoothed[word])), pa.array(sums(mixed) + end),
                ], names=COLUMNS)
                if not local.all():
                    rare = np.flatnonzero(~local)
                    who, none = pa.array(owner[rare]), pa.nulls(len(rare), pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        doc.take(who), rev.take(who), train.take(who), pa.array(s.distinct[s.place[rare]].view(np.int64)), pa.array(own[rare].astype(np.int64)),
                        none, pa.nulls(len(rare), pa.float64()), pa.array(said[rare].astype(np.float64)),
                    ], names=COLUMNS)

    return score


def mixture(model_log10: np.ndarray, others: np.ndarray, log_total: float) -> np.ndarray:
    """log10 of the mixture of the model's probability and a word's share, ``others`` being its count in other texts."""
    return np.log10(MODEL_WEIGHT * 10.0**model_log10 + (1 - MODEL_WEIGHT) * np.maximum(others, 0) * 10.0**-log_total + 1e-300)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


@dataclass
class Learnt:
    """What scoring knows: the counts' table and its totals, the attention model."""

    counts: DataFrame
    model: Model
    train_tokens: int
    distinct: int
    train_docs: int


def learn(train_docs: DataFrame, subwords: Subwords, passes: int = 1, rates: tuple[float, ...] = RATES) -> Learnt:
    """Counts of all words and pairs of pieces of ``train_docs`` (doc_id, text), and the attention model, trained on all their places."""
    spark = train_docs.sparkSession
    size = subwords.size
    raw = train_docs.select("text").mapInArrow(_count_batches(subwords), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = materialize(raw, "lm-counts")
    pairs = counts.where(F.col("kind") == PAIR).select((F.col("key") / size).cast("int").alias("before"), (F.col("key") % size).cast("int").alias("piece"), "n")
    by_piece = pairs.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most a row a piece
    piece_n = np.zeros(size)
    piece_n[by_piece["piece"].to_numpy(dtype=np.int64)] = by_piece["n"].to_numpy(dtype=np.float64)
    classes = choose_classes(piece_n)
    of = spark.createDataFrame(list(enumerate(classes.tolist())), "piece int, class int")  # a row a piece
    got = pairs.join(F.broadcast(of), "piece").groupBy("before", "class").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x classes rows
    to_class = np.zeros((size, CLASSES), dtype=np.float32)
    to_class[got["before"].to_numpy(dtype=np.int64), got["class"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float32)
    n_train = train_docs.count()
    n, v = counts.where(F.col("kind") == TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = train(train_docs, subwords, start(classes, piece_n, to_class), passes, rates)
    return Learnt(counts, model, n + n_train, v + (n_train > 0), n_train)


def score(docs: DataFrame, subwords: Subwords, passes: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document.

    Null and empty texts are an end alone. A null doc_id counts as an empty text for the hold-out. Repeated rows stay and score
    alike. What is sent to all tasks has a fixed size: the model's tables and the counts of ``FREQUENT`` words; the counts of
    all other words are joined. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    learnt = learn(docs.where(~held_out(F.col("doc_id"))), subwords, passes)
    words = learnt.counts.where(F.col("kind") == TOKEN).select("key", "n")
    below = float(np.log10(learnt.train_tokens + 0.5 * (learnt.distinct + 1)))
    log_total = float(np.log10(max(1, learnt.train_tokens)))
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    keys = top["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    n = top["n"].to_numpy(dtype=np.float64)[order]
    shared, frequent = spark.sparkContext.broadcast(learnt.model), spark.sparkContext.broadcast((keys[order], n, np.log10(n + 0.5) - below))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("rev"), (~held_out(F.col("doc_id"))).alias("train"), "text")
    rows = materialize(keyed.mapInArrow(_score_batches(subwords, shared, frequent, log_total), SCORED), "lm-scored")
    # rows of texts have no key and stay out of the join, or all of them would meet in one task
    texts = rows.where("key is null").select("doc_id", "rev", F.lit(1).cast("long").alias("own"), F.col("n").alias("n_words"), "n_known", "base", "score")
    c = F.coalesce("c", F.lit(0))
    others = F.greatest(c - F.when(F.col("train"), F.col("n")).otherwise(0), F.lit(0))
    mixed = F.log10(F.lit(MODEL_WEIGHT) * F.pow(F.lit(10.0), F.col("score")) + F.lit((1 - MODEL_WEIGHT) * 10.0**-log_total) * others + F.lit(1e-300))
    joined = rows.where("key is not null").join(words.withColumnRenamed("n", "c"), "key", "left").select(
        "doc_id", "rev", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("n_words"), (c > 0).cast("long").alias("n_known"), (F.log10(c + 0.5) - below).alias("base"), mixed.alias("score")
    )
    names = ("own", "n_words", "n_known", "base", "score")
    part = joined.groupBy("doc_id", "rev").agg(*[F.sum(c).alias(c) for c in names])
    sums = texts.unionByName(part).groupBy("doc_id", "rev").agg(*[F.sum(c).alias(c) for c in names])
    end = float(np.log10(learnt.train_docs + 0.5) - below)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))  # repeated rows were summed together
    return sums.withColumn("_copy", each).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        (F.col("n_words") / F.col("own") + 1).cast("long").alias("n_tokens"),
        ((F.col("n_known") / F.col("own")).cast("long") + int(learnt.train_docs > 0)).alias("n_known"),
        F.lit(int(learnt.train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("own") + end).alias("base_score"),
        (F.col("score") / F.col("own")).alias("score"),
    )
