"""Chat formatting from relational turns. Spark expressions only.

One conversation is one string of blocks, a block being the adjacent turns of one role:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

with <|next|> between the merged turns. Inside roles and texts every control string, ours or that of other common
templates, gets a tilde after its first character (and one more where it has some already), so that no control string
is left and the change can be taken back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows the first character and any tildes of a control string (fixed values).
_TAIL = r"(\|[A-Za-z_]{1,32}\||/?s>|<SYS>>|</SYS>>|/?INST\])"
_PLAIN = r"([<\[])(~*)" + _TAIL
_MARKED = r"([<\[])~(~*)" + _TAIL
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1$2$3")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are (start, length) in code points of formatted, one per assistant turn.

    Turns sort by (turn, role, text), so that repeated turn numbers have one defined order and repeated rows all stay;
    null roles and texts count as empty; rows with a null conv_id form one conversation; an empty table gives none.
    A conversation is one row of the result, so its turns meet in one task; collect_list combines them map-side.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")

    def piece(t: Column, i: Column) -> Column:
        """A turn's own part of the string: head, text, tail. Neighbours of one role share a block."""
        role = escape(t["role"])
        opens = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        closes = (i == n - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(TURN), role, F.lit(TEXT))).otherwise(F.lit(NEXT)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == TRAINED_ROLE).alias("trained"),
        )

    pieces = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    width = lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((acc["at"] + width(p)).alias("at"), F.when(p["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("pieces", start, walk, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns, as an array of (role, text), back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        role = unescape(F.substring(parts[0], len(TURN) + 1, 1 << 30))
        return F.transform(F.split(parts[1], r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """Per conversation what reading the formatted string back gives: counts and hashes."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
