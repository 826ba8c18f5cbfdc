"""Chat formatting in DataFrame expressions only.

A conversation's rows are collected as structs, sorted by turn and folded into one string and a loss mask. A turn is
``### role: text</turn>`` and a line feed; adjacent turns of one role share a header and are parted by ``</part>``.
In texts and roles ``\\``, ``<``, ``#`` (and ``:`` in roles) are written ``\\b``, ``\\l``, ``\\h`` (``\\c``), so that no
text can hold a control string, and ``parse_chat`` gives back every turn as it was.

The loss mask is an array of spans (start from 0 and length, in code points of the formatted text), one for each
turn of the trained role, which cover exactly the escaped texts.

Defined results: null text and null role are empty; null turns come last; rows of equal turn are ordered by role and
text, and repeated rows are all kept; the rows of a null conversation id form one conversation; an empty table gives
an empty result; extra columns are ignored. A conversation is one row, so its formatted text must fit in one (2 GB).
Turns are folded in blocks of ``BLOCK``, so that arrays which grow turn by turn stay short in conversations of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, PART_END = "</turn>\n", "</part>"
#: Turns folded, or spans read, as one block.
BLOCK = 512
SPAN = "struct<start:int,length:int>"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col``, formatted string, loss_spans array<struct<start int, length int>>."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").isNull().alias("last"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    convs = rows.select(F.col(f"`{conv_col}`").alias("_conv"), turn.alias("_turn")).groupBy("_conv").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    none = F.array().cast(f"array<{SPAN}>")

    def fold(seen: Column, turn: Column) -> Column:
        coded = escape(turn["text"])
        header = F.concat(F.lit("### "), F.replace(escape(turn["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
        lead = F.when(seen["role"].isNull(), header).when(seen["role"] == turn["role"], F.lit(PART_END)).otherwise(F.concat(F.lit(TURN_END), header))
        span = F.struct((seen["chars"] + F.length(lead)).alias("start"), F.length(coded).alias("length"))
        return F.struct(
            turn["role"].alias("role"),
            (seen["chars"] + F.length(lead) + F.length(coded)).alias("chars"),
            F.concat(seen["pieces"], F.array(F.concat(lead, coded))).alias("pieces"),
            F.when(turn["role"] == trained_role, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"),
        )

    def block(at: Column) -> Column:
        # A block goes on with the role of the turn before it; its places count from its own start.
        start = F.struct(F.get(F.col("_turns"), at - 1)["role"].alias("role"), F.lit(0).alias("chars"), F.array().cast("array<string>").alias("pieces"), none.alias("spans"))
        done = lambda held: F.struct(held["chars"].alias("chars"), F.array_join(held["pieces"], "").alias("text"), held["spans"].alias("spans"))
        return F.aggregate(F.slice("_turns", at + 1, BLOCK), start, fold, done)

    blocks = convs.select("_conv", F.transform(F.sequence(F.lit(0), F.size("_turns") - 1, F.lit(BLOCK)), block).alias("_blocks"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("_blocks", begin, lambda held, b: F.struct((held["at"] + b["chars"]).alias("at"), F.concat(held["starts"], F.array(held["at"])).alias("starts")), lambda held: held["starts"])
    # The starts are an argument and not looked up in the lambda, where they would be folded anew for each span.
    moved = F.zip_with("_blocks", starts, lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length"))))
    spans = F.when(F.size("_blocks") == 1, F.get("_blocks", F.lit(0))["spans"]).otherwise(F.flatten(moved))
    return blocks.select(F.col("_conv").alias(conv_col), F.concat(F.array_join(F.transform("_blocks", lambda b: b["text"]), ""), F.lit(TURN_END)).alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns as they were before formatting."""

    def parts(turn: Column) -> Column:
        coded = F.substring_index(turn, ": ", 1)
        role = unescape(F.replace(F.substr(coded, F.lit(5)), F.lit("\\c"), F.lit(":")))
        body = F.substr(turn, F.length(coded) + 3)
        return F.transform(F.split(body, PART_END), lambda part: F.struct(role.alias("role"), unescape(part).alias("text")))

    turns = F.split(formatted, TURN_END)
    return F.flatten(F.transform(F.slice(turns, 1, F.size(turns) - 1), parts))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans. A block of spans is read from its own part."""

    def block(at: Column) -> Column:
        own = F.slice(loss_spans, at + 1, BLOCK)
        first, last = F.element_at(own, 1), F.element_at(own, -1)
        part = F.struct(F.substr(formatted, first["start"] + 1, last["start"] + last["length"] - first["start"]).alias("text"), first["start"].alias("at"))
        return F.array_join(F.flatten(F.transform(F.array(part), lambda p: F.transform(own, lambda s: unescape(F.substr(p["text"], s["start"] - p["at"] + 1, s["length"]))))), "")

    few = F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
    return F.when(F.size(loss_spans) <= BLOCK, few).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.size(loss_spans) - 1, F.lit(0)), F.lit(BLOCK)), block), ""))


def chat_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted text and the loss mask hold, read back from them."""
    back = formatted.select(conv_col, "formatted", parse_chat(F.col("formatted")).alias("_turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
