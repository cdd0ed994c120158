"""Preference formatting: one prompt and two masked completions from a pair of conversations.

Turns of both sides meet by number. The prompt is the longest run of turns, from the first,
that both sides have alike; what follows on either side is its completion. Only built-in
functions are used, and no conversation is gathered whole: turns are grouped by number, the
first difference is a minimum, and long conversations come in parts of a fixed number of turns,
counted from their first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.numbering import number_rows

TURNS_A_PART = 64
# The marks of a common public chat template.
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(BREAK))


def rendered(turns: Column) -> Column:
    """Text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def mask_runs(turns: Column, trained_role: str) -> Column:
    """Runs of the rendered text in order: how many characters, and whether loss is taken on them.

    Loss is taken on the text and end mark of turns of the trained role.
    """

    def of_turn(t: Column) -> Column:
        trained = t["role"] == trained_role
        body = F.length(F.concat(t["text"], F.lit(END)))
        return F.array(
            F.struct(F.length(_head(t)).alias("n_chars"), F.lit(False).alias("trained")),
            F.struct(body.alias("n_chars"), trained.alias("trained")),
        )

    return F.flatten(F.transform(turns, of_turn))


def _side(turns: DataFrame, chosen: bool) -> DataFrame:
    known = turns.filter("pair_id is not null and turn is not null")
    turn = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return known.select("pair_id", F.col("turn").cast("bigint").alias("turn"), F.lit(chosen).alias("is_chosen"), turn.alias("said"))


def format_pairs(
    chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant", turns_a_part: int = TURNS_A_PART
) -> DataFrame:
    """pair_id, part, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    chosen, rejected: pair_id, turn, role, text. Turns go by number, gaps allowed; numbers may
    start anywhere. Turns of one side that share a number count as one, ordered by role and text,
    repeated rows among them once. Null roles and texts count as empty. Rows without pair_id or
    turn belong to no conversation. A pair with one side only has an empty prompt; equal sides
    have empty completions. A pair of up to turns_a_part turns is one row, whatever their numbers; a longer
    one goes on in further parts of as many turns: concatenating a pair's parts in order
    gives the whole; n_prompt_turns counts the prompt's turns in the part.
    """
    turns = _side(chosen, True).unionByName(_side(rejected, False)).distinct()
    said = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("said"))))
    met = turns.groupBy("pair_id", "turn").agg(
        said(F.col("is_chosen")).alias("chosen"), said(~F.col("is_chosen")).alias("rejected")
    )
    first = met.groupBy("pair_id").agg(F.min(F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))).alias("first"))
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    # numbered apart from the texts, which stay where they are
    positions = number_rows(turns.select("pair_id", "turn").distinct(), ["pair_id"], "turn", "position")
    split = met.join(positions, ["pair_id", "turn"]).join(first, "pair_id").select(
        "pair_id",
        F.floor(F.col("position") / turns_a_part).cast("bigint").alias("part"),
        F.struct(
            "turn",
            F.when(shared, F.col("chosen")).otherwise(none).alias("prompt"),
            F.when(shared, none).otherwise(F.col("chosen")).alias("chosen"),
            F.when(shared, none).otherwise(F.col("rejected")).alias("rejected"),
        ).alias("row"),
        shared.cast("bigint").alias("shared"),
    )
    parts = split.groupBy("pair_id", "part").agg(
        F.array_sort(F.collect_list("row")).alias("rows"), F.sum("shared").alias("n_prompt_turns")
    )
    whole = lambda name: F.flatten(F.transform("rows", lambda r: r[name]))
    return parts.select(
        "pair_id",
        "part",
        "n_prompt_turns",
        rendered(whole("prompt")).alias("prompt"),
        rendered(whole("chosen")).alias("chosen"),
        rendered(whole("rejected")).alias("rejected"),
        mask_runs(whole("chosen"), trained_role).alias("chosen_mask"),
        mask_runs(whole("rejected"), trained_role).alias("rejected_mask"),
    )


def with_stale_reply(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns (pair_id, turn, role, text) made from conversations.

    A conversation as it stands is chosen. In the rejected one the last assistant turn gives
    the first assistant turn's text again, or an empty text where there is only one. Where no
    turn is the assistant's, both are the same.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    spoken = turns.filter((F.col("role") == "assistant") & F.col("turn").isNotNull())
    ends = spoken.groupBy("pair_id").agg(
        F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("first"), F.max("turn").alias("last")
    )
    stale = F.when(F.col("first.turn") < F.col("last"), F.col("first.text")).otherwise(F.lit(""))
    replaced = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    rejected = turns.join(ends, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(replaced, stale).otherwise(F.col("text")).alias("text")
    )
    return turns, rejected
