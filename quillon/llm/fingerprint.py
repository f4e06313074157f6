"""Document fingerprints: invertible Bloom lookup tables over paragraph digests, with Spark expressions only.

A text's paragraphs are its lines, cut after sentences, so an edit touches only the paragraphs it is in. Each different
paragraph has a 64-bit digest. A table has three regions of cells; a digest adds its count, itself and its
check to one cell of each region. The fingerprint is the first, small table. Tables of two versions are
subtracted, and peeling cells that hold a single digest recovers the digests that differ. Where two
versions differ by more paragraphs in number than the first table has cells, its peeling cannot end and is not begun; there, and where it stalls, a
larger table with other places is tried, split into sub-tables by a hash so that the work grows with the text and not
with its square.

Cells are rows: a table is an aggregation of exploded digests by (row, sub-table, cell), a subtraction adds the other
version's digests with the opposite sign, and a round of peeling is one more aggregation, in which a cell that
holds a single digest gives it off and takes it out of its two other cells. All of that happens where the rows of
a text lie after one shuffle of the digests; no array is searched, and cells are dropped once they are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, numbered

#: Cells in a region of the first table; of a sub-table at each retry; digests that a sub-table is meant for.
FIRST, RETRIES, LOAD = 8, (32, 64, 128), 12
#: Rounds of peeling, each of the cells of one region in turn, so that no digest is taken out twice.
ROUNDS = 9
#: Texts in a partition of the tables.
PART_ROWS = 2000
LEAST = -(1 << 63)


def digests(text: Column) -> Column:
    """The digests of a text's different paragraphs; a null text has none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\n.!?\u3002\uFF01\uFF1F]+[.!?\u3002\uFF01\uFF1F]*)"), F.lit(1))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _place(digest: Column, region: int, cells: int, salt: int) -> Column:
    """The cell of a digest in a region, counted from the table's first."""
    mixed = F.xxhash64(digest, F.lit(salt)) if salt else digest
    return (F.pmod(F.call_function("shiftrightunsigned", mixed, F.lit(region * 18)), F.lit(cells)) + region * cells).cast("int")


def _cells(signed: DataFrame, by: list[str], cells: int, salt: int) -> DataFrame:
    """The table of rows (``by``, d, sign): (``by``, cell, d null, n, k, h), a row a cell that is not empty.

    n is the sum of the signs, k the xor of the digests, h the xor of their checks.
    """
    spread = signed.select(*by, "d", "sign", F.explode(F.array(*[_place(F.col("d"), r, cells, salt) for r in range(3)])).alias("cell"))
    return spread.groupBy(*by, "cell").agg(F.sum("sign").alias("n"), F.bit_xor("d").alias("k"), F.bit_xor(F.hash("d")).alias("h"))


def peel(table: DataFrame, by: list[str], cells: int, salt: int, rounds: int = ROUNDS) -> DataFrame:
    """(``by``, cell, d, n): digests recovered from a table (d not null, n the side), and what cells are left (d null)."""
    rows = table.withColumn("d", F.lit(None).cast("long"))
    for k in range(rounds):
        region = k % 3
        here = F.col("d").isNull() & (F.floor(F.col("cell") / cells) == region)
        pure = here & (F.abs("n") == 1) & (F.hash("k") == F.col("h"))
        row = lambda cell, d, n, x, h: F.struct(cell.cast("int").alias("cell"), d.cast("long").alias("d"), n.cast("long").alias("n"), x.cast("long").alias("k"), h.cast("int").alias("h"))
        same = row(F.col("cell"), F.col("d"), F.col("n"), F.col("k"), F.col("h"))
        found = row(F.lit(-1), F.col("k"), F.col("n"), F.lit(0), F.lit(0))
        others = [row(_place(F.col("k"), r, cells, salt), F.lit(None), -F.col("n"), F.col("k"), F.col("h")) for r in range(3) if r != region]
        given = rows.select(*by, F.explode(F.when(pure, F.array(found, *others)).otherwise(F.array(same))).alias("c")).select(*by, "c.*")
        rows = given.groupBy(*by, "cell", "d").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
        rows = rows.where("d is not null or n <> 0 or k <> 0 or h <> 0")
    return rows


def _spread(rows: DataFrame) -> DataFrame:
    """Dealt out by row, so that every aggregation after it finds a text's rows in one place: as many parts as the session's shuffles have, or more for few cores."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    return rows.repartition(max(1, min(rows.count() // PART_ROWS, most)), "row")


def _estimate(squares: Column, total: Column, cells: int) -> Column:
    """How many digests differ, from the counts of the cells of all three regions: their squares' sum, and the sum of all counts.

    A digest of either version alone adds one to the expected square of its cell; what the two sizes differ by spreads over all.
    """
    even = total / 3
    return F.greatest(F.lit(0.0), (squares / 3 - even * even / cells) / (1 - 1 / cells))


def _attempt(pairs: DataFrame, cells: int, salt: int, split: bool, sizes: bool = False) -> DataFrame:
    """(row, side, ok, plus, minus) of pairs (row, side, one, other) of digests by one size of table; ``sizes``: only how many."""
    most = F.greatest(F.size("one"), F.size("other"), F.lit(1))
    parts = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(most / LOAD)))).cast("int") if split else F.lit(1)
    side = lambda c, sign: F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(sign).cast("long").alias("sign")))
    # a table gives off no more digests than it has cells, and at least as many differ as the sizes do
    may_end = F.lit(True) if split else F.abs(F.size("one") - F.size("other")) <= 3 * cells
    signed = pairs.where(may_end).withColumn("parts", parts).select("row", "side", "parts", F.explode(F.concat(side("one", 1), side("other", -1))).alias("s"))
    signed = signed.select("row", "side", F.pmod(F.hash("s.d", F.lit(salt)), F.col("parts")).alias("part"), "s.d", "s.sign")
    by = ["row", "side", "part"]
    found = peel(_cells(signed, by, cells, salt), by, cells, salt)
    # ok: no cell is left over, also for a pair of texts without any digest
    recovered = lambda sign: F.when((F.col("n") == sign) & F.col("d").isNotNull(), F.col("d"))
    pick = lambda sign: F.count(recovered(sign)) if sizes else F.collect_list(recovered(sign))
    got = found.groupBy("row", "side").agg(F.sum(F.col("d").isNull().cast("long")).alias("left"), pick(1).alias("plus"), pick(-1).alias("minus"))
    empty = F.lit(0).cast("long") if sizes else F.array().cast("array<bigint>")
    return pairs.select("row", "side", may_end.alias("may_end")).join(got, ["row", "side"], "left").select(
        "row", "side", (F.col("may_end") & (F.coalesce("left", F.lit(0)) == 0)).alias("ok"), F.coalesce("plus", empty).alias("plus"), F.coalesce("minus", empty).alias("minus")
    )


def difference(pairs: DataFrame, sizes: bool = False) -> DataFrame:
    """(row, side, plus, minus): the digests of either version alone, or how many, for pairs (row, side, one, other) of digests.

    The small tables are tried first, then larger ones, each only for pairs on which the one before stalled. Should the
    largest stall as well (two digests that share all cells in every table), signs are summed digest by digest, so
    no result is lost. (row, side) is unique, ``row`` a long; equal lists have no difference. A table in the shared folder.
    """
    done, pending = [], pairs
    for k, cells in enumerate((FIRST, *RETRIES)):
        tried = materialize(_attempt(_spread(pending), cells, k, k > 0, sizes), f"fingerprint-try-{k}")
        done.append(tried.where("ok").drop("ok"))
        stalled = tried.where("not ok").select("row", "side")
        if stalled.isEmpty():
            break
        pending = pairs.join(stalled, ["row", "side"], "left_semi")
    else:
        held = lambda x, y: F.size(F.array_except(x, y)).cast("long") if sizes else F.array_except(x, y)
        done.append(pending.select("row", "side", held("one", "other").alias("plus"), held("other", "one").alias("minus")))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def encode(items: DataFrame, cells: int = FIRST) -> DataFrame:
    """(row, side, fingerprint) of (row, side, items): the first table as text, 28 hex digits a cell."""
    signed = _spread(items).select("row", "side", F.explode("items").alias("d"), F.lit(1).cast("long").alias("sign"))
    part = F.concat(F.lpad(F.hex(F.col("n").bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lpad(F.hex("k"), 16, "0"), F.lpad(F.hex(F.col("h").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    texts = _cells(signed, ["row", "side"], cells, 0).groupBy("row", "side").agg(F.map_from_entries(F.collect_list(F.struct("cell", part.alias("t")))).alias("cells"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), lambda i: F.coalesce(F.col("cells")[i], F.lit("0" * 28)))
    return items.select("row", "side").join(texts.select("row", "side", F.array_join(filled, "").alias("f")), ["row", "side"], "left").select(
        "row", "side", F.coalesce("f", F.lit("0" * (84 * cells))).alias("fingerprint")
    )


def likeness(one: Column, other: Column, cells: int = FIRST) -> Column:
    """About how alike two texts are, from their fingerprints alone: the share of paragraphs in common, exact for equal fingerprints.

    The counts of the subtracted cells tell how many paragraphs differ, the counts of either how many there are. With 24 cells the number
    that differ is known to about a third of itself. Counts of a cell are kept modulo 2^16.
    """
    count = lambda f, i: F.conv(F.substr(f, i * 28 + 1, F.lit(4)), 16, 10).cast("long")
    at = F.sequence(F.lit(0), F.lit(3 * cells - 1))
    summed = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    size = lambda f: summed(F.transform(at, lambda i: count(f, i))) / 3
    apart = F.transform(at, lambda i: count(one, i) - count(other, i))
    differ = _estimate(summed(F.transform(apart, lambda v: v * v)), summed(apart), cells)
    both = size(one) + size(other)
    return F.when(one == other, 1.0).otherwise(F.greatest(F.lit(0.0), (both - differ) / (both + differ)))


def successors(docs: DataFrame) -> DataFrame:
    """(key, next_key, next_rev): for each doc_id the next one in descending order, after the last the first.

    ``docs`` has key and rev. The ids are dealt into ranges, the neighbour is a window inside a range, and
    only the first id of each range is looked at together. Of texts that share an id, the least rev stands for it.
    """
    ids = docs.groupBy("key").agg(F.min("rev").alias("rev"))
    dealt = materialize(ids.repartitionByRange(F.col("key").desc()).withColumn("range", F.spark_partition_id()), "fingerprint-ids")
    heads = dealt.groupBy("range").agg(F.max("key").alias("next_key"), F.max_by("rev", "key").alias("next_rev"))
    around = Window.orderBy("range")  # one row a range
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "range",
        *[F.coalesce(F.lead(c).over(around), F.first(c).over(whole)).alias(f"far_{c}") for c in ("next_key", "next_rev")],
    )
    inside = Window.partitionBy("range").orderBy(F.col("key").desc())
    linked = dealt.withColumn("next_key", F.lead("key").over(inside)).withColumn("next_rev", F.lead("rev").over(inside)).join(heads, "range")
    return linked.select("key", F.coalesce("next_key", "far_next_key").alias("next_key"), F.coalesce("next_rev", "far_next_rev").alias("next_rev"))


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, next_digests) for rows (doc_id, text).

    The edit replaces the last third of the code points by as many of the next document, or all it has. Texts
    are dealt out by their key once; only the head that the edit needs and the digests of the next document travel
    to its predecessor.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    sizes = materialize(base.select("key", F.xxhash64("text").alias("rev"), third.alias("third")), "fingerprint-sizes")
    need = sizes.groupBy("key").agg(F.max("third").alias("need"))
    link = materialize(successors(sizes).join(need, "key").select(F.col("next_key").alias("key"), F.col("next_rev").alias("rev"), F.col("next_key").alias("same"), F.col("key").alias("for_key"), "need"), "fingerprint-links")
    # both joins read the same columns of the texts, and no further equality becomes a key: so one shuffle of the texts serves both
    one = lambda x, y: x.bitwiseXOR(y) == 0
    wanted = base.join(link, "key").where(one(F.xxhash64("text"), F.col("rev")) & one(F.coalesce("doc_id", F.lit(LEAST)), F.col("same")))
    heads = wanted.select(F.col("for_key").alias("key"), F.expr("substring(text, 1, need)").alias("head"), digests(F.col("text")).alias("next_digests")).dropDuplicates(["key"])
    joined = base.join(heads, "key").withColumn("_n", F.char_length("text")).withColumn("_k", F.floor(F.col("_n") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, _n - _k)"), F.expr("substring(head, 1, _k)"))
    return joined.select("doc_id", "text", edited.alias("edited"), "next_digests")


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with digests and fingerprint. A null text counts as empty; repeated rows get equal fingerprints.

    Columns called digests or fingerprint are replaced; other columns may have any names.
    """
    docs = docs.drop("digests", "fingerprint")
    inner, names = numbered(docs, {"row": F.monotonically_increasing_id(), "digests": digests(F.col("text"))})
    rows = materialize(inner, "fingerprint-rows")
    made = encode(rows.select("row", F.lit("a").alias("side"), F.col("digests").alias("items")))
    return rows.join(made.select("row", "fingerprint"), "row").select(*names, "digests", "fingerprint").toDF(*docs.columns, "digests", "fingerprint")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they and the next document's are.

    Likeness is the share of paragraphs in common; the number that differ comes from subtracting and peeling the two
    fingerprints, and from larger tables where those are too small for the difference. One row a
    document; a null text is empty, a null doc_id comes last in descending order; of texts that share an
    id, one stands as the next document, the same in every run. An empty table gives an empty result.
    """
    edits = with_edits(docs)
    rows = materialize(edits.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), F.col("next_digests").alias("c"),
    ), "fingerprint-rows")
    sided = lambda sides, *cols: rows.select("row", *cols, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("x")) for s in sides])).alias("s"))
    prints = encode(sided("ab").select("row", "s.side", F.col("s.x").alias("items")))
    counts = difference(sided("bc", F.col("a").alias("one")).select("row", "s.side", "one", F.col("s.x").alias("other")), sizes=True)
    at = lambda frame, side, *cols: frame.where(F.col("side") == side).select("row", *cols)
    slim = rows.select("row", "doc_id", "n_chars", "edited_sha256", F.size("a").alias("n_a"))
    whole = slim.join(at(prints, "a", "fingerprint"), "row").join(at(prints, "b", F.col("fingerprint").alias("edited_fingerprint")), "row")
    for side in "bc":
        whole = whole.join(at(counts, side, F.col("plus").alias(f"plus_{side}"), F.col("minus").alias(f"minus_{side}")), "row")
    near = lambda s: F.when(F.col("n_a") + F.col(f"minus_{s}") == 0, F.lit(1.0)).otherwise((F.col("n_a") - F.col(f"plus_{s}")) / (F.col("n_a") + F.col(f"minus_{s}")))
    return whole.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("b").alias("near_edited"), near("c").alias("near_next"))
