"""Mining of phrases whose words stay together.

1. Texts are cut into slices of one language, at the ends of pieces, so no phrase is divided. A slice is written as
   one row: its different words, and its words as places in that list, zero between pieces.
2. Words are dealt out, sorted and counted by runs. Each frequent one gets an id, and every slice is told the ids of its own: that is
   the dictionary, which may grow with the corpus, as no task ever holds it whole. All other words become zeros. An encoded slice
   has its ids once, in order, and a code of four bytes for each place.
3. A phrase of k words is the pair of the two phrases of k - 1 words that it begins and ends with. So each pass packs pairs of
   neighbouring ids into binary keys of fixed width, counts them within a slice, deals them into ranges of keys, sorts them there
   and counts runs. Frequent pairs get ids in turn, slices are encoded anew, zero wherever a pair is rare, and the next pass counts
   phrases one word longer among what is left.
4. The table of a phrase is joined from the tables of its two halves, whose words and counts it carries on; cuts, scores and
   containment need nothing else.

A hot word or phrase has one row for each slice at most before any shuffle. Slices are long rows, so few of them are read or handed to Python at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
NO_LANG = "und"
#: Bytes of text of one slice, about, and of all languages' texts that a task holds before it cuts them.
SLICE_BYTES, HELD_BYTES = 8 << 20, 24 << 20
#: Parts in which a language's best phrases are chosen before they meet.
PARTS = 64
#: Ids that a task gathers before it tells them to slices, about; keys that each slice gives to the sample from which ranges are drawn.
TOLD, SAMPLED = 1 << 19, 64
#: Spark's settings for what is held beside a row: bytes of a batch that goes to Python and rows of a batch that is read, as a row may be a slice.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "4"}
CODED = "slice long, codes array<int>, ids array<long>"
SLICES = "slice long, lang string, tokens array<int>, words array<string>, counts array<int>"

WORD_BYTE, GAP, BREAK = 0, 1, 2
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[ord(" "), ord("\t")]] = GAP
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Some bytes in parts of about a slice, cut behind a byte that ends a piece."""
    while len(raw) > SLICE_BYTES:
        ends = np.flatnonzero(KINDS[raw[:SLICE_BYTES]] == BREAK)
        upto = SLICE_BYTES
        while not len(ends) and upto < len(raw):  # a piece longer than a slice stays whole
            ends = np.flatnonzero(KINDS[raw[upto : upto + SLICE_BYTES]] == BREAK) + upto
            upto += SLICE_BYTES
        cut = int(ends[-1]) + 1 if len(ends) else len(raw)
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def encode_words(raw: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
    """(tokens, different words, how often each occurs) of some text; token w + 1 is word w, 0 stands between pieces."""
    low = LOWER[raw]
    kind = KINDS[low]
    inside = np.concatenate([[False], kind == WORD_BYTE, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return None
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    said = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside[1:-1]])]).dictionary_encode()
    ids = said.indices.to_numpy() + 1
    piece = np.cumsum(kind == BREAK, dtype=np.int32)[starts]
    opens = np.zeros(len(starts), dtype=np.int64)
    opens[1:] = piece[1:] != piece[:-1]
    tokens = np.zeros(len(ids) + int(opens.sum()), dtype=np.int32)
    tokens[np.arange(len(ids)) + np.cumsum(opens)] = ids
    return tokens, said.dictionary.cast(pa.string()), np.bincount(ids)[1:].astype(np.int32)


def _lists(values, kind: pa.DataType) -> pa.Array:
    """One list as a column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[str, list[bytes]] = {}
    size, made = 0, TaskContext.get().partitionId() << 32

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal made
        for lang, texts in sorted(held.items()):
            for part in _pieces(np.frombuffer(b"\n".join(texts), dtype=np.uint8)):
                if (found := encode_words(part)) is not None:
                    tokens, words, counts = found
                    yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([lang]), _lists(tokens, pa.int32()), _lists(words, pa.string()), _lists(counts, pa.int32())], names=["slice", "lang", "tokens", "words", "counts"])
                    made += 1

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            raw = text.as_buffer()
            if raw is None or not raw.size:
                continue
            held.setdefault(lang.as_py(), []).append(raw.to_pybytes())
            size += raw.size
            if size >= HELD_BYTES:
                yield from flushed()
                held, size = {}, 0
    yield from flushed()


def _items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of a column of lists, and where each row's begin (one more: the end)."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Codes without zeros that follow a zero, or stand at the ends."""
    stays = codes != 0
    stays[1:] |= codes[:-1] != 0
    codes = codes[stays]
    return codes[:-1] if len(codes) and not codes[-1] else codes


def _joined(column: pa.Array, row: int, kind: str) -> np.ndarray:
    """The numbers of a row's list of binary values, one behind the other."""
    return np.frombuffer(b"".join(column[row].as_py()), dtype=kind)


def _coded(slices: pa.Array, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A slice's row: zero or a place in the sorted list of its ids, counted from one, for each place of its text."""
    return pa.RecordBatch.from_arrays([slices, _lists(_squeezed(codes), pa.int32()), _lists(ids, pa.int64())], names=["slice", "codes", "ids"])


def _slices_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, codes, ids) of each slice."""
    codes, at = _items(batch.column("codes"))
    ids, begin = _items(batch.column("ids"))
    for row in range(batch.num_rows):
        yield row, codes[at[row] : at[row + 1]], ids[begin[row] : begin[row + 1]]


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices as runs of codes of dictionary ids, with a zero wherever other words or the ends of pieces stood."""
    for batch in batches:
        tokens, at = _items(batch.column("tokens"))
        for row in range(batch.num_rows):
            own = tokens[at[row] : at[row + 1]]
            told = _joined(batch.column("told"), row, "<i8")
            ids = np.sort(told)
            table = np.zeros(int(own.max(initial=0)) + 1, dtype=np.int32)
            table[_joined(batch.column("of"), row, "<i4") + 1] = np.searchsorted(ids, told) + 1
            yield _coded(batch.column("slice").slice(row, 1), table[own], ids)


def packed(first: np.ndarray, second: np.ndarray, width: int) -> np.ndarray:
    """Pairs of ids as binary keys of two times ``width`` bytes, big-endian, so they sort as the pairs do."""
    if width == 4 and max(first.max(initial=0), second.max(initial=0)) >> 32:
        raise ValueError("ids do not fit into four bytes")
    return np.ascontiguousarray(np.stack([first, second], axis=1).astype(f">u{width}")).view(f"V{2 * width}").ravel()


def _binary(keys: np.ndarray) -> pa.Array:
    width = keys.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(keys)])


def _keys(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of fixed width as an array."""
    first = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=f"V{width}", count=len(column), offset=first)


def neighbours(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of the different pairs of neighbours that are no zeros, in order."""
    both = (codes[:-1] != 0) & (codes[1:] != 0)
    pair, n = np.unique(codes[:-1][both].astype(np.int64) << 32 | codes[1:][both], return_counts=True)
    return ids[(pair >> 32) - 1], ids[(pair & 0xFFFFFFFF) - 1], n


def _place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a pair stands in the order of keys, as a float: rounded, but alike for equal pairs and never out of order."""
    return first.astype(np.float64) * 2.0**32 + second


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some pairs of each slice, evenly spaced, from which only the ends of ranges follow."""
    for batch in batches:
        for _, codes, ids in _slices_of(batch):
            both = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
            both = both[:: max(1, len(both) // SAMPLED)]
            yield pa.RecordBatch.from_arrays([pa.array(_place(ids[codes[both] - 1], ids[codes[both + 1] - 1]))], names=["place"])


def _pair_batches(width: int, ends: list[float]):
    """The different pairs of each slice, how often each occurs there, and the range of keys it falls into."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, codes, ids in _slices_of(batch):
                first, second, n = neighbours(codes, ids)
                part = np.searchsorted(np.asarray(ends), _place(first, second), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), _binary(packed(first, second, width)), pa.array(n), pa.array(np.full(len(n), batch.column("slice")[row].as_py()))], names=["part", "key", "n", "slice"])

    return made


def _longer_batches(width: int):
    """Slices encoded anew: the id of the pair that begins at each place, zero where it is rare."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, codes, ids in _slices_of(batch):
                key = _joined(batch.column("of"), row, f">u{width}").astype(np.int64).reshape(-1, 2)
                told = _joined(batch.column("told"), row, "<i8")
                longer = np.sort(told)
                known = np.searchsorted(ids, key[:, 0]) + 1 << 32 | np.searchsorted(ids, key[:, 1]) + 1
                order = np.argsort(known)
                known, new = known[order], (np.searchsorted(longer, told[order]) + 1).astype(np.int32)
                pair = codes[:-1].astype(np.int64) << 32 | codes[1:]
                hit = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                yield _coded(batch.column("slice").slice(row, 1), np.where(known[hit] == pair, new[hit], np.int32(0)), longer)

    return made


RUNS = "id long, key binary, f long, slice long, of binary, told binary"


def _run_lengths(least: int, parts: int, tell: bool, width: int = 0, part=None):
    """Sums over the runs of equal keys in sorted rows, each key of ``least`` or more with an id: (id, key, f), and for slices (slice, of, told).

    ``of`` says what a slice is told ids of, one behind the other: its keys, if they have a fixed ``width``, else their ``place``
    in its list of words; ``told`` are the ids. Rows wait only until their key has reached ``least``, after fewer than ``least`` rows; what is
    to be told is told when ``TOLD`` ids are together. Ids count on by ``parts``, from the number of the task, so no two are the same.
    """
    names = RUNS.replace(" long", "").replace(" binary", "").split(", ")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() if part is None else part
        if own >= parts:
            raise ValueError(f"task {own} of {parts}")
        number = own + 1
        last, total, waiting = None, 0, []
        told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        counted: list[tuple[int, bytes, int]] = []

        def ended() -> None:
            """The run at hand has ended."""
            nonlocal number, total, waiting
            if total >= least:
                counted.append((number, last, total))
                number += parts
            total, waiting = 0, []

        def rows() -> pa.RecordBatch:
            ids, keys, f = zip(*counted)
            n = len(ids)
            counted.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(f, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)

        def tellings() -> pa.RecordBatch:
            slices, of, ids = (np.concatenate(x) for x in zip(*told))
            order = np.argsort(slices, kind="stable")
            slices, of, ids = slices[order], of[order], ids[order]
            head = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
            ends = np.append(head[1:], len(slices))
            none = pa.nulls(len(head), pa.int64())
            said = [pa.array([x[a:b].tobytes() for a, b in zip(head, ends)], pa.binary()) for x in (of, ids)]
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(head), pa.binary()), none, pa.array(slices[head]), *said], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key")
            n, slices = batch.column("n").to_numpy(), batch.column("slice").to_numpy()
            of = _keys(key, 2 * width) if width else batch.column("place").to_numpy().astype("<i4")
            head = np.flatnonzero(np.concatenate([[True], pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)]))
            ends = np.append(head[1:], len(key))
            sums = np.add.reduceat(n, head)
            if last is not None and key[0].as_py() != last:
                ended()
            # runs that are rare and whole within this batch need no look; the first and the last may go on
            looked = np.concatenate([[0], np.flatnonzero(sums[1:-1] >= least) + 1, [len(head) - 1] if len(head) > 1 else []]).astype(int)
            for run in looked.tolist():
                a, b = int(head[run]), int(ends[run])
                last = key[a].as_py()
                total += int(sums[run])
                if tell:
                    waiting.append((slices[a:b].copy(), of[a:b].copy()))  # a view would hold its whole batch
                    if total >= least:
                        for x, y in waiting:
                            told.append((x, y, np.full(len(x), number, dtype="<i8")))
                            size += len(x)
                        waiting = []
                if run < len(head) - 1:
                    ended()
            if counted:
                yield rows()
            if size >= TOLD:
                yield tellings()
                told, size = [], 0
        ended()
        if counted:
            yield rows()
        if told:
            yield tellings()

    return made


def _told(runs: DataFrame) -> DataFrame:
    """(slice, of, told): all that each slice is told."""
    return runs.where("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("of", "told")).alias("t")).select("slice", "t.of", "t.told")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile ``BATCHES`` holds; afterwards what held before."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pairs_by_runs(ids: DataFrame, least: int, width: int, name: str, tell: bool) -> DataFrame:
    """Pairs of neighbours counted: dealt into ranges of keys, sorted there and counted by runs; a table in the shared folder."""
    parts = _parts(ids)
    # a sketch of the sampled places, not the sample, reaches the driver
    ends = ids.mapInArrow(_sample_batches, "place double").agg(F.percentile_approx("place", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    pairs = ids.mapInArrow(_pair_batches(width, sorted(set(ends or []))[: parts - 1]), "part int, key binary, n long, slice long")
    dealt = pairs.repartitionById(parts, "part").drop("part").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(_run_lengths(least, parts, tell, width), RUNS), name)


def phrase_levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of one word, two words and so on, and of totals (lang, n).

    A phrase has id, the ids ``left`` and ``right`` of the phrases one word shorter that it begins and ends with, lang, words, f,
    and the counts ``fl`` of its beginnings and ``fr`` of its ends, by their number of words.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    slices = materialize(texts.mapInArrow(_cut_batches, SLICES), "phrase-slices")
    totals = materialize(slices.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "phrase-totals")
    # a language in hex and a space stand before the word, so the key tells both
    key = F.encode(F.concat(F.hex(F.encode("lang", "UTF-8")), F.lit(" "), F.col("w.words")), "UTF-8")
    said = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("slice", "place", key.alias("key"), F.col("w.counts").cast("long").alias("n"))
    parts = _parts(docs)
    runs = materialize(said.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_run_lengths(least, parts, tell=True), RUNS), "phrase-word-runs")
    said = F.decode("key", "UTF-8")
    word, own = F.substring_index(said, " ", -1), F.array("f")
    words = runs.where("id is not null").select("id", F.decode(F.unhex(F.substring_index(said, " ", 1)), "UTF-8").alias("lang"), F.array(word).alias("words"), "f", own.alias("fl"), own.alias("fr"))
    words = materialize(words, "phrase-words")
    ids = materialize(slices.select("slice", "tokens").join(_told(runs), "slice").mapInArrow(_encode_batches, CODED), "phrase-ids")
    discard(slices, runs)
    levels = [words]
    for k in range(2, longest + 1):
        width = 4 if k == 2 else 8
        runs = _pairs_by_runs(ids, least, width, f"phrase-runs-{k}", tell=k < longest)
        half = lambda at: F.conv(F.hex(F.substring("key", at, width)), 16, 10).cast("long")
        found = runs.where("id is not null").select("id", "f", half(1).alias("left"), half(width + 1).alias("right"))
        left = levels[-1].select(F.col("id").alias("left"), "lang", "words", "fl")
        right = levels[-1].select(F.col("id").alias("right"), F.col("words").alias("more"), "fr")
        joined = found.join(left, "left").join(right, "right")
        levels.append(materialize(joined.select("id", "left", "right", "lang", F.concat("words", F.slice("more", -1, 1)).alias("words"), "f", F.concat("fl", own).alias("fl"), F.concat("fr", own).alias("fr")), f"phrase-level-{k}"))
        if k < longest:
            spent, ids = ids, materialize(ids.join(_told(runs), "slice").mapInArrow(_longer_batches(width), CODED), f"phrase-ids-{k}")
            discard(spent)
        discard(runs)
    discard(ids)
    return levels, totals


def exact_score(left, right):
    """1000 * f * n / (left * right), rounded down; products have up to 38 digits."""
    over = F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)")
    return F.call_function("div", over, left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase has 2 to ``longest`` words in one piece and occurs ``least`` times or more. It is scored where it is cut
    worst, 1000 * a * n / (l * r) rounded down in exact arithmetic; of equal cuts the first counts. Phrases inside a
    longer one that occurs ``share`` percent as often go. Null texts are empty, a null lang is ``und``; repeated rows count
    as often as they stand. An empty table gives an empty result. Columns other than text and lang are not read.
    """
    with _small_batches(docs.sparkSession):
        return _best(*phrase_levels(docs, least, longest), longest, top, share)


def _best(levels: list[DataFrame], totals: DataFrame, longest: int, top: int, share: int) -> DataFrame:
    """Phrases scored, those inside longer ones dropped, and each language's best ranked."""
    rows = None
    for k, level in enumerate(levels[1:], 2):
        cuts = [F.struct(exact_score(F.col("fl")[j - 1], F.col("fr")[k - j - 1]).alias("score"), F.lit(j).alias("cut"), F.col("fl")[j - 1].alias("l"), F.col("fr")[k - j - 1].alias("r")) for j in range(1, k)]
        scored = level.join(totals, "lang").select("id", "lang", "words", F.col("f").alias("a"), "n", F.array_min(F.array(*cuts)).alias("w")).select("id", "lang", "words", "a", "n", "w.*")
        if k <= longest - 1:
            # what lies inside a phrase that is longer by more than a word lies inside one between them, which is as frequent at least
            covered = levels[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            scored = scored.join(covered, "id", "left").where(f"longer is null or 100 * longer < {share} * a").drop("longer")
        rows = scored if rows is None else rows.unionByName(scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = rows.withColumn("phrase", F.array_join("words", " ")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # a language's best are chosen by parts, so its last window sorts PARTS * top rows at most
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = materialize(rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-best")
    discard(*levels, totals)
    return out
