"""Operator 5: preference pairs as one prompt and two masked completions.

A pair holds two conversations that may begin alike: the chosen one and the
rejected one. Their longest common turn prefix (equal role and text, turn by
turn) is rendered once as the prompt; what follows is rendered as the chosen
and the rejected completion. Only the replies of a completion count in
training: the mask gives the spans of characters (start:end, from the start
of the completion) that are assistant texts with their closing mark; headers
and other roles' turns are masked out.

Everything is DataFrame operations. Turns of both sides meet by place in one
grouping by pair; prefix lengths are folds over the two arrays. A row of the
result holds one whole pair, so a pair's turns come together in one row, as
the result itself does; pairs are dealt evenly whatever texts they share.

Defined results: turns are ordered by their number, ties by role and text
(NULL first); a NULL role is "user", a NULL text is empty; a side without
turns gives an empty completion, and with it an empty prefix; repeated rows
are turns of their own; rows with a NULL conversation take no part; an empty
table gives no rows; a conversation of any length is one row, as its result is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLIES = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """All turns of an array of (role, text), one after another."""
    return F.array_join(F.transform(turns, _rendered), "")


def reply_spans(turns: Column) -> Column:
    """Spans (start:end, joined by commas) of the replies in ``render``'s
    text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"]) + 7
        span = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"),
                        F.when(turn["role"] == REPLIES, F.concat(state["spans"], span))
                         .otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: F.array_join(state["spans"], ","))


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that are equal."""
    both = F.least(F.size(chosen), F.size(rejected))
    equal = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(equal, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(both.cast("long")).cast("int")


def _turn(turn: str, role: str, text: str) -> Column:
    return F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))


def gathered(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """A row a conversation: its id and ``turns``, in order."""
    one = _turn(turn, role, text)
    return turns.where(F.col(conversation).isNotNull()).groupBy(conversation).agg(
        F.sort_array(F.collect_list(one)).alias("turns"))


def format_pairs(turns: DataFrame, pair: str = "pair_id", chosen: str = "chosen", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """``format_sides`` of ``turns``: a row a turn, with the pair it belongs
    to and whether its conversation is the chosen one."""
    one = _turn(turn, role, text)
    sides = turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id")).agg(
        F.sort_array(F.collect_list(F.when(F.col(chosen), one))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col(chosen), one))).alias("r"))
    return format_sides(sides, "pair_id", "c", "r")


def format_sides(sides: DataFrame, pair: str = "pair_id", chosen: str = "chosen",
                 rejected: str = "rejected") -> DataFrame:
    """A row a pair: pair_id, prefix_turns, prompt, chosen, chosen_spans,
    rejected, rejected_spans. ``sides`` has a row a pair with both arrays of
    turns (turn, role, text), as ``gathered`` gives them; neither is NULL."""
    met = sides.select(F.col(pair).alias("pair_id"), F.col(chosen).alias("c"), F.col(rejected).alias("r")) \
        .withColumn("prefix_turns", common_prefix(F.col("c"), F.col("r")))
    n = F.col("prefix_turns")

    def head(a: str) -> Column:
        return F.slice(a, F.lit(1), n)

    def tail(a: str) -> Column:
        return F.slice(a, n + 1, F.greatest(F.size(a), F.lit(1)))

    return met.select("pair_id", "prefix_turns", render(head("c")).alias("prompt"),
                      render(tail("c")).alias("chosen"), reply_spans(tail("c")).alias("chosen_spans"),
                      render(tail("r")).alias("rejected"), reply_spans(tail("r")).alias("rejected_spans"))
