"""SentencePiece encoding and decoding by a max-plus scan.

A segmentation of a text into pieces is the one that byte-pair merging gives if and only if every two
neighbouring pieces stay as they are when merged alone. So encoding is a best path in a lattice whose nodes are pieces, whose edges
join neighbours that are stable together, and whose weights are the pieces' scores; a prefix has one such path.

Giant texts are split into chunks. A boundary state is the piece that covers the last character before
the cut. Each chunk yields a transfer matrix, the best score from each state at its left to each at its right; the matrices of a
text are combined by the associative max-plus product, neighbours first, in a tree of Spark joins, which fixes the state
at every cut, and then every chunk is traced back by itself. No piece has the space mark inside, so a matrix needs a search over states only up to
the first and from the last start of a word in its chunk.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import discard, materialize, numbered
from quillon.llm.grams import BYTE_BASE, ranges, slices

MARK = "▁"
#: Characters of a chunk; texts up to that length are one chunk.
CHUNK = 50_000
#: Pairs of pieces that a task remembers as stable or not; ids that are decoded at a time.
CACHE, SLICE_IDS = 50_000, 1 << 18
#: Characters of a part that is merged pair by pair; numbers from here on are characters without a piece.
LONG, UNKNOWN = 40, 1 << 24
WORST = float("-inf")
#: State of a text's two ends.
EDGE = (0, "")


class PairTable:
    """Pairs of numbers under 2^31 and their places in a list, found for many pairs at once: an open hash table in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left << 31) + right
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.values = np.full(self.mask + 1, -1, dtype=np.int64)
        self.probes, waiting = 0, np.arange(len(keys))
        while len(waiting):
            slot = (self._slot(keys[waiting]) + self.probes) & self.mask
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[waiting[free]]
            self.values[slot[free]] = waiting[free]
            waiting = waiting[self.keys[slot] != keys[waiting]]
            self.probes += 1
        # of two that wanted a free slot the last one has it, with its own value
        self.values[self.keys >= 0] = 0
        found = self._find_slots(keys)
        self.values[found] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _find_slots(self, keys: np.ndarray) -> np.ndarray:
        first, out = self._slot(keys), np.full(len(keys), -1, dtype=np.int64)
        for k in range(self.probes):
            slot = (first + k) & self.mask
            out = np.where((out < 0) & (self.keys[slot] == keys), slot, out)
        return out

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self._find_slots((left << 31) + right)
        return np.where(slot >= 0, self.values[slot], -1)


class Pieces:
    """A vocabulary: pieces with scores, and the ids of single bytes for characters it lacks."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.scores, self.byte_ids = scores, byte_ids
        self.longest = max(map(len, scores))
        #: Scores of pieces, and None for what only begins one.
        self.prefixes: dict[str, float | None] = {p[:n]: None for p in scores for n in range(1, len(p))}
        self.prefixes.update((p, s) for p, (_, s) in scores.items())
        #: Characters that follow each other inside some piece; no piece crosses any other pair.
        self.inner = {a + b for p in scores for a, b in zip(p, p[1:])}
        self.score = {p: s for p, (_, s) in scores.items()}.get
        # numbers of pieces, as the merging of many parts sees them
        self.symbol_text = list(scores)
        self.symbol_of = {p: k for k, p in enumerate(self.symbol_text)}
        self.symbol_id = np.array([scores[p][0] for p in self.symbol_text], dtype=np.int64)
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        for k, p in enumerate(self.symbol_text):
            if len(p) == 1:
                self.char_symbol[ord(p)] = k
        halves = [(self._symbol(p[:n]), self._symbol(p[n:]), k) for k, p in enumerate(self.symbol_text) for n in range(1, len(p))]
        left, right, whole = np.array([h for h in halves if h[0] >= 0 and h[1] >= 0], dtype=np.int64).reshape(-1, 3).T
        self.pairs, self.pair_symbol = PairTable(left, right), whole
        ranks = np.unique([scores[p][1] for p in self.symbol_text], return_inverse=True)[1]
        self.pair_rank = ranks.ravel()[whole]
        follow = np.array(sorted({(ord(a), ord(b)) for a, b in self.inner}), dtype=np.int64).reshape(-1, 2)
        self.inner_pairs = PairTable(follow[:, 0], follow[:, 1])
        self.stable_pairs: dict[tuple[str, str], bool] = {}

    @staticmethod
    def load(path: str) -> Pieces:
        """Read a SentencePiece model of byte-pair kind, on the driver; tasks get the vocabulary, which is of fixed size."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte_ids = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
        return Pieces({model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, [byte_ids[f"<0x{b:02X}>"] for b in range(256)])

    def __reduce__(self):
        return _pieces, (self.scores, self.byte_ids)

    def _symbol(self, text: str) -> int:
        """The number of a piece, or of a character without one; -1 for any other text."""
        return self.symbol_of.get(text, UNKNOWN + ord(text) if len(text) == 1 else -1)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best pair whose union is a piece, leftmost first, until none is left."""
        parts, score = list(text), self.score
        pairs = [score(a + b, WORST) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == WORST:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], WORST)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], WORST)
        return parts

    def stable(self, a: str, b: str) -> bool:
        key = (a, b)
        got = self.stable_pairs.get(key)
        if got is None:
            if len(self.stable_pairs) > CACHE:
                self.stable_pairs.clear()
            got = self.stable_pairs[key] = self.merged(a + b) == [a, b]
        return got

    def best_path(self, text: str, start: int, last: str | None) -> tuple[list, list]:
        """Forward pass from ``start`` (after the piece ``last``): piece and score of the best path to each end."""
        n = len(text)
        piece: list = [None] * (n + 1)
        score = [float("-inf")] * (n + 1)
        piece[start], score[start] = last or "", 0.0
        prefixes, stable = self.prefixes, self.stable
        for begin in range(start, n):
            before = piece[begin]
            if before is None:
                continue
            for end in range(begin + 1, n + 1):
                p = text[begin:end]
                got = prefixes.get(p, 0)
                if got == 0:  # no piece begins so; a character without a piece stands alone
                    if end == begin + 1:
                        got = 0.0
                    else:
                        break
                if got is not None and score[begin] + got > score[end] and (not before or stable(before, p)):
                    piece[end], score[end] = p, score[begin] + got
                if end == begin + 1 and got == 0.0:
                    break
        return piece, score

    def ids_of(self, piece: str) -> tuple[int, ...]:
        got = self.scores.get(piece)
        return (got[0],) if got else tuple(self.byte_ids[b] for b in piece.encode("utf-8", "replace"))

    def path(self, unit: str) -> list[str]:
        """The pieces on the best path of the lattice, which are those of merging, in time linear in the unit's length."""
        piece, _ = self.best_path(unit, 0, None)
        at, out = len(unit), []
        while at:
            out.append(piece[at])
            at -= len(piece[at])
        return out[::-1]

    def cut(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all tokens, and how many each has. A token is spaces, which stand for marks, and what follows them.

        Tokens are cut where two characters follow each other in no piece, and the parts are merged all at once.
        """
        said = [t.decode("utf-8", "replace") for t in tokens]
        chars = np.frombuffer("".join(said).replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)))
        symbols = np.where(self.char_symbol[chars] >= 0, self.char_symbol[chars], UNKNOWN + chars)
        begins = np.ones(len(chars), dtype=bool)
        begins[1:] = self.inner_pairs.find(chars[:-1], chars[1:]) < 0
        begins[ends[:-1][ends[:-1] < len(chars)]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(chars)))
        out, counts = self.merge(symbols, starts, lengths)
        # parts of a token, then characters without a piece as their bytes
        per_part = np.concatenate([[0], np.cumsum(counts)])
        of_token = per_part[np.searchsorted(starts, ends)]
        lost = np.flatnonzero(out >= UNKNOWN)
        n = np.ones(len(out), dtype=np.int64)
        raw = [chr(c).encode("utf-8", "replace") for c in (out[lost] - UNKNOWN).tolist()]
        n[lost] = [len(x) for x in raw]
        at = np.concatenate([[0], np.cumsum(n)])
        ids = np.repeat(self.symbol_id[np.where(out < UNKNOWN, out, 0)], n)
        for k, x in zip(lost.tolist(), raw):
            ids[at[k] : at[k + 1]] = [self.byte_ids[b] for b in x]
        return ids.astype(np.int32), np.diff(np.concatenate([[0], at[of_token]]))

    def merge(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merging of many parts at once: (symbols left, how many of each part).

        A round merges the best pair of every part, leftmost first, and leaves out parts that have none. Parts longer
        than ``LONG`` take the best path of the lattice.
        """
        parts = len(starts)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # parts, their symbols one after another
        many = lengths <= LONG
        for k in np.flatnonzero(~many).tolist():
            text = "".join(self.symbol_text[x] if x < UNKNOWN else chr(x - UNKNOWN) for x in symbols[starts[k] : starts[k] + lengths[k]].tolist())
            found = [self.symbol_of.get(p, UNKNOWN + ord(p[0])) for p in self.path(text)]
            done.append((np.full(len(found), k), np.array(found, dtype=np.int64)))
        owner = np.repeat(np.arange(parts), lengths)
        held = many[owner]
        owner, x = owner[held], symbols[held]

        def looked(x: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The pair table's entries of places and what follows them in their part, -1 where none."""
            follows = np.minimum(at + 1, len(x) - 1)
            same = (at + 1 < len(x)) & (owner[follows] == owner[at])
            return np.where(same, self.pairs.find(x[at], x[follows]), -1)

        pair = looked(x, owner, np.arange(len(x))) if len(x) else np.empty(0, np.int64)
        while len(x):
            rank = np.where(pair >= 0, self.pair_rank[pair], -1)
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.maximum.reduceat(rank, head), np.diff(np.append(head, len(x))))
            over = best < 0
            if over.any():
                done.append((owner[over], x[over]))
                going = ~over
                owner, x, pair, rank, best = owner[going], x[going], pair[going], rank[going], best[going]
                if not len(x):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            x[at] = self.pair_symbol[pair[at]]
            keep = np.ones(len(x), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            owner, x, pair, at = owner[keep], x[keep], pair[keep], place[at]
            changed = np.concatenate([at, at[at > 0] - 1])
            pair[changed] = looked(x, owner, changed)
        whose, what = (np.concatenate(c) for c in zip(*done)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(whose, kind="stable")
        return what[order], np.bincount(whose, minlength=parts)

    def encode(self, marked: str, into: array) -> None:
        """The ids of a text of whole words, word by word."""
        words = [w.encode() for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)]
        if words:
            into.extend(self.cut([w.replace(MARK.encode(), b" ") for w in words])[0].tolist())

    # chunks of giant texts

    def states(self, left: str, right: str) -> list[tuple[int, str]]:
        """All pieces that cover the last character of ``left``: (characters before the cut, piece)."""
        out = []
        for before in range(1, min(self.longest, len(left)) + 1):
            for after in range(0, min(self.longest - before, len(right)) + 1):
                p = left[len(left) - before :] + right[:after]
                if p in self.scores or len(p) == 1:
                    out.append((before, p))
        return out

    def word_starts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last word start in text[low:high], where no piece crosses."""
        found = re.compile(f"(?<=[^{MARK}]){MARK}")
        first = found.search(text, max(low, 1), high)
        if not first:
            return None
        at = high
        while at > low:  # the last one, searched from the right
            at = text.rfind(MARK, low, at)
            if at > 0 and text[at - 1] != MARK:
                return first.start(), at
        return first.start(), first.start()

    def transfer(self, left: str, body: str, right: str, first: bool, last: bool) -> list[tuple[tuple, tuple, float]]:
        """(left state, right state, score) of a chunk, whose neighbours' ends are ``left`` and ``right``.

        A score counts the pieces that begin inside the chunk.
        """
        return [(i, o, s) for i, o, s, _ in self._paths(left, body, right, first, last, None, None, False)]

    def trace(self, left: str, body: str, right: str, first: bool, last: bool, enter: tuple, leave: tuple) -> array:
        """The ids of the pieces that begin inside the chunk, given its states."""
        (_, _, _, ids), = self._paths(left, body, right, first, last, enter, leave, True)
        return ids

    def _walk(self, text: str, begin: int, last: str | None, ends: list[tuple[int, str]]) -> list[tuple[tuple[int, str], float, list[str]]]:
        """Best paths from ``begin`` to each of ``ends``: (last position, piece that must end there, or '' for any)."""
        piece, score = self.best_path(text, begin, last)
        out = []
        for end, must in ends:
            start = end - len(must)
            if must:
                before = piece[start] if begin <= start <= len(text) else None
                if before is None or before and not self.stable(before, must):
                    continue
                total, path, at = score[start] + self.scores.get(must, (0, 0.0))[1], [must], start
            else:
                if piece[end] is None:
                    continue
                total, path, at = score[end], [], end
            while at > begin:
                path.append(piece[at])
                at -= len(piece[at])
            out.append(((end, must), total, path[::-1]))
        return out

    def _paths(self, left, body, right, first, last, enter, leave, want_ids):
        text = left + body + right
        low, high = len(left), len(left) + len(body)
        enters = [enter] if enter else [EDGE] if first else self.states(left, body + right)
        leaves = [leave] if leave else [EDGE] if last else self.states(left + body, right)
        starts = self.word_starts(text, low + self.longest, high - self.longest)
        ends = [(high - before + len(p), p) if p else (high, "") for before, p in leaves]
        for state in enters:
            begin = low - state[0] + len(state[1])
            if starts is None:
                walked = {e: (s, path) for e, s, path in self._walk(text[: high + len(right)], begin, state[1], ends)} if begin <= high + len(right) else {}
                found = [(o, *walked[e]) for o, e in zip(leaves, ends) if e in walked]
                middle = ""
            else:
                a, b = starts
                head = self._walk(text[:a], begin, state[1], [(a, "")]) if begin <= a else []
                if not head:
                    continue
                tail = {e: (s, path) for e, s, path in self._walk(text, b, None, ends)}
                middle = text[a:b]
                found = [(o, head[0][1] + tail[e][0], (head[0][2], tail[e][1])) for o, e in zip(leaves, ends) if e in tail]
            for out, score, path in found:
                ids = array("i")
                if want_ids:
                    before, after = path if starts is not None else (path, [])
                    for p in before:
                        ids.extend(self.ids_of(p))
                    self.encode(middle, ids)
                    for p in after:
                        ids.extend(self.ids_of(p))
                yield state, out, score, ids


_SHARED: dict[int, Pieces] = {}


def _pieces(scores: dict[str, tuple[int, float]], byte_ids: list[int]) -> Pieces:
    """The vocabulary in a worker process, built once for all of its tasks."""
    key = hash((tuple(scores.items()), tuple(byte_ids)))
    if key not in _SHARED or _SHARED[key].scores != scores:
        _SHARED[key] = Pieces(scores, byte_ids)
    return _SHARED[key]


def marked(text: str) -> str:
    """A text as the lattice sees it: spaces are marks, and one mark comes first."""
    return MARK + text.replace(" ", MARK) if text else ""


def _tokens(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes with one space before each text that is not empty, starts of tokens, tokens up to each text).

    A token is a run of spaces with what follows up to the next one. No piece crosses from one token to the next.
    """
    for words in slices(texts):
        filled = np.diff(words.text_at) > 0
        data = np.insert(words.data, words.text_at[:-1][filled], 32)
        text_at = words.text_at + np.concatenate([[0], np.cumsum(filled)])
        space = data == 32
        is_start = space.copy()
        is_start[1:] &= ~space[:-1]
        is_start[text_at[:-1][filled]] = True
        starts = np.flatnonzero(is_start)
        yield words.rows, data, starts, np.searchsorted(starts, text_at)


def _encode_batches(pieces: Pieces, names: list[str], text: str):
    """Different tokens of a slice of the column ``text`` are cut once; their ids are gathered for all places by numpy."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts, upto in _tokens(batch.column(text)):
                ends = np.append(starts[1:], len(data))
                _, first, place = np.unique(ranges(data.astype(np.uint64) + np.uint64(1), BYTE_BASE, starts, ends), return_index=True, return_inverse=True)
                raw = data.tobytes()
                flat, lengths = pieces.cut([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
                n = lengths[place]
                cuts = np.concatenate([[0], np.cumsum(n)])
                ids = flat[np.repeat((np.cumsum(lengths) - lengths)[place] - cuts[:-1], n) + np.arange(cuts[-1])]
                listed = pa.ListArray.from_arrays(pa.array(cuts[upto].astype(np.int32)), pa.array(ids))
                own = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in names] + [listed], names=names + ["ids"])

    return encode


CHUNK_TYPE = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("chunk", pa.int32()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string()), ("final", pa.bool_())])


def _chunk_batches(pieces: Pieces, size: int):
    pad = pieces.longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                text = marked(text)
                n = -(-len(text) // size)
                for k, at in enumerate(range(0, len(text), size)):
                    part = (text[max(0, at - pad) : at], text[at : at + size], text[at + size : at + size + pad])
                    yield pa.RecordBatch.from_pylist([dict(zip(CHUNK_TYPE.names, (row, n, k, *part, at + size >= len(text))))], schema=CHUNK_TYPE)

    return cut


def _transfer_frames(pieces: Pieces):
    def transfer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r.row, r.n, r.chunk, i[0], i[1], o[0], o[1], s) for r in frame.itertuples() for i, o, s in pieces.transfer(r.left, r.body, r.right, r.chunk == 0, r.final)]
            yield pd.DataFrame(out, columns=["row", "n", "chunk", "in_at", "in_piece", "out_at", "out_piece", "score"])

    return transfer


def _product(matrices: DataFrame) -> DataFrame:
    """Max-plus products of neighbouring chunks' matrices: chunk k of the result joins chunks 2k and 2k + 1.

    A matrix is its rows (row, n, chunk, i, o, score); ``n`` is the number of chunks of its text. A last chunk without
    a neighbour stays as it is.
    """
    half = F.shiftright("chunk", 1).alias("chunk")
    size = F.shiftright(F.col("n") + 1, 1).alias("n")
    left = matrices.where("chunk % 2 = 0 and chunk + 1 < n").select("row", size, half, "i", F.col("o").alias("mid"), "score")
    right = matrices.where("chunk % 2 = 1").select("row", half, F.col("i").alias("mid"), "o", F.col("score").alias("more"))
    joined = left.join(right, ["row", "chunk", "mid"]).groupBy("row", "n", "chunk", "i", "o").agg(F.max(F.col("score") + F.col("more")).alias("score"))
    return joined.unionByName(matrices.where("chunk % 2 = 0 and chunk + 1 = n").select("row", size, half, "i", "o", "score"))


def _parts(states: DataFrame, matrices: DataFrame) -> DataFrame:
    """The states (row, chunk, i, o) of single chunks from those of pairs of chunks: the middle state on the best path."""
    whole = states.select("row", F.col("chunk").alias("pair"), "i", "o")
    with_pair = lambda rows: rows.withColumn("pair", F.shiftright("chunk", 1))
    left = with_pair(matrices.where("chunk % 2 = 0 and chunk + 1 < n")).select("row", "pair", "i", F.col("o").alias("mid"), "score")
    right = with_pair(matrices.where("chunk % 2 = 1")).select("row", "pair", F.col("i").alias("mid"), "o", F.col("score").alias("more"))
    ways = whole.join(left, ["row", "pair", "i"]).join(right, ["row", "pair", "mid", "o"])
    best = ways.groupBy("row", "pair", "i", "o").agg(F.max_by("mid", F.struct(F.col("score") + F.col("more"), F.col("mid"))).alias("mid"))
    both = F.array(F.struct((F.col("pair") * 2).alias("chunk"), F.col("i").alias("i"), F.col("mid").alias("o")), F.struct((F.col("pair") * 2 + 1).alias("chunk"), F.col("mid").alias("i"), F.col("o").alias("o")))
    alone = with_pair(matrices.where("chunk % 2 = 0 and chunk + 1 = n")).select("row", "pair", "chunk").distinct()
    alone = whole.join(alone, ["row", "pair"]).select("row", "chunk", "i", "o")
    return best.select("row", F.explode(both).alias("s")).select("row", "s.chunk", "s.i", "s.o").unionByName(alone)


def chunk_states(matrices: DataFrame) -> DataFrame:
    """(row, chunk, i, o): the state on the best path at the left and right end of every chunk.

    The product is associative, so the matrices of a text are combined in a tree: about log2 of the number of
    chunks joins up, and as many down, in which each pair's middle state follows from its two ends.
    """
    levels = [materialize(matrices, "pieces-matrices-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        levels.append(materialize(_product(levels[-1]), f"pieces-matrices-{len(levels)}"))
        most = (most + 1) // 2
    states = levels[-1].select("row", "chunk", "i", "o")
    for matrices in levels[-2::-1]:
        states = _parts(states, matrices)
    states = materialize(states, "pieces-states")
    discard(*levels)
    return states


def _trace_frames(pieces: Pieces):
    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [list(pieces.trace(r.left, r.body, r.right, r.chunk == 0, r.final, (r.in_at, r.in_piece), (r.out_at, r.out_piece))) for r in frame.itertuples()]
            yield pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "ids": ids})

    return trace


MATRIX = "row long, n int, chunk int, in_at int, in_piece string, out_at int, out_piece string, score double"
CHUNKS = "row long, n int, chunk int, left string, body string, right string, final boolean"


def encode(docs: DataFrame, pieces: Pieces, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids, the piece ids of every whole text, as the SentencePiece library gives them.

    Texts of more than ``chunk`` characters are encoded chunk by chunk in tasks of their own, with the same
    ids. A null or empty text has no ids; repeated rows stay. A column ids is replaced; other columns may have any
    names. An empty table gives an empty result.
    """
    docs = docs.drop("ids")
    inner, names = numbered(docs, {})
    text = names[docs.columns.index("text")]
    schema = T.StructType([*inner.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    long = F.coalesce(F.char_length(text), F.lit(0)) > chunk
    short = inner.where(~long).mapInArrow(_encode_batches(pieces, names, text), schema)
    giants = materialize(inner.where(long).select(F.monotonically_increasing_id().alias("row"), *names), "pieces-giants")
    chunks = materialize(giants.select("row", F.col(text).alias("text")).mapInArrow(_chunk_batches(pieces, chunk), CHUNKS).repartition("row", "chunk"), "pieces-chunks")
    ends = [F.struct(F.col(f"{side}_at").alias("at"), F.col(f"{side}_piece").alias("piece")).alias(side[0]) for side in ("in", "out")]
    states = chunk_states(chunks.mapInPandas(_transfer_frames(pieces), MATRIX).select("row", "n", "chunk", *ends, "score"))
    flat = states.select("row", "chunk", F.col("i.at").alias("in_at"), F.col("i.piece").alias("in_piece"), F.col("o.at").alias("out_at"), F.col("o.piece").alias("out_piece"))
    traced = chunks.join(flat, ["row", "chunk"]).mapInPandas(_trace_frames(pieces), "row long, chunk int, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda c: c["ids"])).alias("ids"))
    both = short.unionByName(giants.join(whole, "row").select(*names, "ids"))
    return both.toDF(*docs.columns, "ids")


def _decode_batches(texts: list[bytes], names: list[str], ids_name: str):
    known, lengths = np.frombuffer(b"".join(texts), dtype=np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
    where = np.cumsum(lengths) - lengths

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(ids_name)
            every = listed.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            every = np.where((every >= 0) & (every < len(texts)), every, len(texts) - 1)
            counts = np.concatenate([[0], np.cumsum(listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            first = 0
            while first < batch.num_rows:
                # rows of about SLICE_IDS ids, one row at least
                last = min(batch.num_rows, max(first + 1, int(np.searchsorted(counts, counts[first] + SLICE_IDS, side="right")) - 1))
                ids = every[counts[first] : counts[last]]
                n = lengths[ids]
                cuts = np.concatenate([[0], np.cumsum(n)])
                raw = known[np.repeat(where[ids] - cuts[:-1], n) + np.arange(cuts[-1])].tobytes()
                cuts = cuts[counts[first : last + 1] - counts[first]].tolist()
                out = [raw[a + 1 if raw[a : a + 1] == b" " else a : b].decode("utf-8", "replace") if a < b else "" for a, b in zip(cuts[:-1], cuts[1:])]
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in names] + [pa.array(out, pa.string())], names=names + ["decoded"])
                first = last

    return decode


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with decoded, the text of the ids: marks become spaces, byte ids bytes, and the first space goes.

    Null ids decode to an empty text; ids outside the vocabulary have no text. A column decoded is replaced; other columns
    may have any names.
    """
    texts = [b""] * (2 + max([i for i, _ in pieces.scores.values()] + pieces.byte_ids))  # the last one: no text
    for p, (i, _) in pieces.scores.items():
        texts[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(pieces.byte_ids):
        texts[i] = bytes([b])
    encoded = encoded.drop("decoded")
    inner, names = numbered(encoded, {})
    schema = T.StructType([*inner.schema.fields, T.StructField("decoded", T.StringType())])
    return inner.mapInArrow(_decode_batches(texts, names, names[encoded.columns.index("ids")]), schema).toDF(*encoded.columns, "decoded")
