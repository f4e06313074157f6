"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged by an
array aggregation, and the blocks are concatenated under this template::

    <|im_start|>role\ntext[<|im_sep|>text of the next turn of that role ...]<|im_end|>\n

Control strings cannot occur inside texts: every ``<``, any backslashes and ``|`` get one backslash more,
and reading back takes one away. Roles are percent-escaped, as a role ends at the first newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCKS = "array<struct<role:string,texts:array<string>>>"
SPANS = "array<struct<start:bigint,length:bigint>>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def _merge(blocks: Column, turn: Column) -> Column:
    """Append a turn: to the last block if that has the same role, else as a block of its own."""
    last = F.element_at(blocks, -1)
    alone = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
    joined = F.array(F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
    same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
    return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), joined)).otherwise(F.concat(blocks, alone)).cast(BLOCKS)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, n_blocks, formatted, loss_spans) of the rows (conv_id, turn, role, text).

    ``loss_spans`` holds a (start, length) in code points of ``formatted`` for each text of ``loss_role``:
    the loss mask. Turns of one number are ordered by role, then text; null turn numbers come first, null
    roles and texts count as empty, each row without a conv_id is a conversation of its own. Repeated rows are
    repeated turns. Other columns are ignored. An empty table gives an empty result.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # rows without an id never meet; which number keeps them apart doesn't matter
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    merged = rows.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.expr(f"cast(array() as {BLOCKS})"), _merge).alias("blocks"),
    )

    def pieces(block: Column) -> Column:
        piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        body = F.flatten(F.transform(block["texts"], lambda t, i: F.array(
            piece(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")), F.lit(False)),
            piece(escape_text(t), block["role"] == loss_role))))
        head = F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n"))
        return F.concat(F.array(piece(head, F.lit(False))), body, F.array(piece(F.lit(END + "\n"), F.lit(False))))

    cut = merged.select("conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", pieces)).alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        n = F.char_length(p["s"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        spans = F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), spans.cast(SPANS).alias("spans"))

    return cut.select(
        "conv_id", "n_turns", "n_blocks",
        F.array_join(F.transform("p", lambda p: p["s"]), "").alias("formatted"),
        F.aggregate("p", zero, walk, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """Read a formatted conversation back: array<struct<role, text>>, one entry a turn."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def block(b: Column) -> Column:
        rest = F.substr(b, F.lit(len(START) + 1))
        head = F.substring_index(rest, "\n", 1)
        texts = F.split(F.substr(rest, F.char_length(head) + 2), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape_role(head).alias("role"), unescape_text(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted text and its mask, a row a conversation."""
    turns = parse_chat(F.col("formatted"))
    back = formatted.select("conv_id", "n_blocks", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
