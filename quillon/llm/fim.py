"""Fill-in-middle transformation of texts, by a byte automaton.

A table-driven automaton reads the UTF-8 bytes once. Each of its transitions says whether the byte opens a unit (a run
of letters, or any other code point), opens a code point, or completes a sentinel; the transitions are counted up to
each end of a text, and that is all the first scan keeps. A second scan goes only through the blocks that hold a cut
and finds its byte there. As the automaton forgets its state within two bytes, all bytes of a block are looked up
together. Blocks have a fixed size, so a very long text needs no more memory than its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import numbered

#: Sentinels in front of the prefix, the suffix and the middle; the letters stand in the table of bytes below.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed, and how many of these have the suffix in front.
RATE, SPM_RATE, SEED = 90, 20, 1
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
SLICE_BYTES, BLOCK = 1 << 22, 1 << 20

#: Classes of bytes: any other, a letter, a continuation byte, "<", ">", a letter that sentinels have.
OTHER, LETTER, CONTINUED, OPEN, CLOSE, NAMED = range(6)
#: States: after anything else, inside a run of letters, after "<", after "<" and a sentinel's letter.
PLAIN, RUN, OPENED, NAMING = range(4)
UNIT, POINT, SENTINEL = 4, 8, 16


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, dtype=np.uint8)
    kinds[0x80:0xC0] = CONTINUED
    for first in (ord("A"), ord("a")):
        kinds[first : first + 26] = LETTER
    kinds[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = NAMED
    kinds[ord("<")], kinds[ord(">")] = OPEN, CLOSE
    return kinds


def _transitions() -> np.ndarray:
    """[state, class] -> next state, with the flags of what the byte opens or completes."""
    table = np.zeros((4, 6), dtype=np.uint8)
    for state in range(4):
        new_run = 0 if state in (RUN, NAMING) else UNIT
        table[state, OTHER] = PLAIN | UNIT | POINT
        table[state, CONTINUED] = PLAIN
        table[state, OPEN] = OPENED | UNIT | POINT
        table[state, CLOSE] = PLAIN | UNIT | POINT | (SENTINEL if state == NAMING else 0)
        table[state, LETTER] = RUN | POINT | new_run
        table[state, NAMED] = (NAMING if state == OPENED else RUN) | POINT | new_run
    return table


CLASSES, TABLE = _classes(), _transitions()
#: The state after two classes of bytes, from whatever state.
AFTER_TWO = np.array([[TABLE[TABLE[PLAIN, a] & 3, b] & 3 for b in range(6)] for a in range(6)], dtype=np.uint8)


def transitions(data: np.ndarray, text_at: np.ndarray, a: int, b: int) -> np.ndarray:
    """The transition at each of the bytes a to b; every text begins in the plain state."""
    kinds = np.full(b - a + 2, OTHER, dtype=np.uint8)
    near = max(0, a - 2)
    kinds[2 - (a - near) :] = CLASSES[data[near:b]]
    one, two = kinds[1:-1].copy(), kinds[:-2].copy()
    starts = text_at[np.searchsorted(text_at, a - 1) : np.searchsorted(text_at, b)] - a
    here = starts[(starts >= 0) & (starts < b - a)]
    one[here], two[here] = OTHER, OTHER
    after = starts[(starts + 1 >= 0) & (starts + 1 < b - a)] + 1
    two[after] = OTHER
    return TABLE[AFTER_TWO[two, one], kinds[2:]]


class Scan:
    """Counts of units, code points and sentinels before each end of a text and each block."""

    def __init__(self, data: np.ndarray, text_at: np.ndarray):
        self.data, self.text_at = data, text_at
        self.before = np.zeros((3, len(text_at)), dtype=np.int64)
        heads = [np.zeros(3, dtype=np.int64)]
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            made = transitions(data, text_at, a, b)
            i, j = np.searchsorted(text_at, [a, b], side="right")
            head = heads[-1].copy()
            for k, flag in enumerate((UNIT, POINT, SENTINEL)):
                sums = np.cumsum((made & flag) != 0)
                self.before[k, i:j] = head[k] + sums[text_at[i:j] - a - 1]
                head[k] += sums[-1]
            heads.append(head)
        self.heads = np.array(heads)

    def cuts(self, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte at which each unit begins, counted over all texts, and the code points before it."""
        byte, points = np.full(len(ordinals), len(self.data)), np.full(len(ordinals), self.heads[-1, 1])
        block = np.searchsorted(self.heads[:, 0], ordinals, side="right") - 1
        for k in np.unique(block[ordinals < self.heads[-1, 0]]):
            a, b = int(k) * BLOCK, min((int(k) + 1) * BLOCK, len(self.data))
            made = transitions(self.data, self.text_at, a, b)
            own = np.flatnonzero(block == k)
            at = np.flatnonzero(made & UNIT)[ordinals[own] - self.heads[k, 0]]
            byte[own] = a + at
            points[own] = self.heads[k, 1] + np.cumsum((made & POINT) != 0)[at] - 1
        return byte, points


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, where each text begins and the end) of a text column, slice by slice; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    everything = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1))
        yield at, upto, everything[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def _batches(rate: int, spm_rate: int, schema: pa.Schema):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            for start, end, data, text_at in _slices(batch.column("text")):
                scan = Scan(data, text_at)
                n, _, sentinels = np.diff(scan.before)
                h1, h2, h3, h4 = (h[start:end] for h in draws)
                plain = (n == 0) | (sentinels > 0) | (h3 % 100 >= rate)
                spm = ~plain & (h4 % 100 < spm_rate)
                first, second = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
                # a cut behind the last unit of a text falls where the next text begins, or at the end
                low, low_points = scan.cuts(scan.before[0, :-1] + first)
                high, high_points = scan.cuts(scan.before[0, :-1] + second)
                for at, points, cut in ((low, low_points, first), (high, high_points, second)):
                    last = cut == n
                    at[last], points[last] = text_at[1:][last], scan.before[1, 1:][last]
                raw, out = data.tobytes(), []
                for a, b, i, j, p, s in zip(text_at[:-1].tolist(), text_at[1:].tolist(), low.tolist(), high.tolist(), plain.tolist(), spm.tolist()):
                    if p:
                        out.append(raw[a:b].decode())
                        continue
                    prefix, middle, suffix = raw[a:i].decode(), raw[i:j].decode(), raw[j:b].decode()
                    out.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if s else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
                new = {
                    "n": pa.array(n), "form": pa.array(np.select([plain, spm], ["plain", "spm"], "psm").astype(object), pa.string()), "output": pa.array(out, pa.string()),
                    "prefix_chars": pa.array(low_points - scan.before[1, :-1], mask=plain), "middle_chars": pa.array(high_points - low_points, mask=plain),
                }
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else rows.column(f.name).cast(f.type) for f in schema], schema=schema)

    return made


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points) and output, the transformed text.

    Four numbers come from the SHA-256 of the seed and the doc_id: the two cuts, and whether and how a text is
    transformed. ``form`` is ``plain`` (the text itself), ``psm`` or ``spm``; prefix_chars and middle_chars are null where
    it is plain. Texts that are empty or hold a sentinel stay plain, so what is transformed can be read back. A null text
    is empty, a null doc_id counts as an empty one, and rows that repeat an id and a text give the same output. An
    empty table gives an empty result. The caller's columns stay, whatever their names; only those called like a result are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(*NEW)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = {f"h{i + 1}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    inner, names = numbered(docs, {"text": F.col("text"), **draws})
    place = docs.columns.index("text")
    kept = [n for i, n in enumerate(names) if i != place]
    # the text goes to the workers once, and comes back as it was
    inner = inner.select(*kept, "text", *draws)
    schema = inner.drop(*draws).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    out = inner.mapInArrow(_batches(rate, spm_rate, to_arrow_schema(schema)), schema)
    return out.select(*[F.col("text" if i == place else n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns))], *NEW)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone.

    No part holds a sentinel, and none can arise where a part meets one, so the first of each sentinel is the true one.
    """
    def between(start: str, end: str | None) -> Column:
        behind = F.substring_index(output, start, -1)
        return behind if end is None else F.substring_index(behind, end, 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
