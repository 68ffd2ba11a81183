"""Preference pairs of conversations as prompt and masked completions, with DataFrame operations only.

Input: a row per turn of the chosen and the rejected conversation of each pair.
The longest common prefix of turns (same role and text, in order) is rendered
once as the prompt; what follows on either side is a completion, a list of
segments of which only assistants' texts, with their end mark, are trained on.

Scale: one shuffle by pair. A pair is one output row, so its turns meet in one
task by nature; nothing larger does, and no turns of different pairs are
compared.

Defined results: rows without pair or turn take no part; rows repeated in all of
pair, side, turn, role and text count once; turns of equal number are in order
of role and text; a null role or text renders as empty; a pair with one side
only has an empty prompt; equal sides have empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the chat template.
START, STOP = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(STOP + "\n"))


def _segments(turn: Column) -> Column:
    """A turn as (text, trained) segments."""
    head = F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))
    body = F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(STOP))
    segment = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
    is_trained = F.coalesce(turn["role"] == TRAINED_ROLE, F.lit(False))
    return F.array(segment(head, F.lit(False)), segment(body, is_trained), segment(F.lit("\n"), F.lit(False)))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays of turns share."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.get(a, i - 1)["role"].eqNullSafe(F.get(b, i - 1)["role"]) & F.get(a, i - 1)["text"].eqNullSafe(F.get(b, i - 1)["text"]))
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, shorter.cast("long"))).cast("int")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: (pair_id, turn, role, text). One row per pair: pair_id, n_prompt_turns, prompt, chosen and rejected (arrays of (text, trained))."""
    columns = ["pair_id", "turn", "role", "text"]
    rows = chosen.select(*columns, F.lit("c").alias("side")).unionByName(rejected.select(*columns, F.lit("r").alias("side")))
    rows = rows.where("pair_id IS NOT NULL AND turn IS NOT NULL")
    turn = F.struct("turn", "role", "text")
    # array_distinct keeps what sort_array put in order
    side = lambda s: F.array_distinct(F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))))
    pairs = rows.groupBy("pair_id").agg(side("c").alias("c"), side("r").alias("r")).withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.flatten(F.transform(F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))), _segments))
    prompt = F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n")), _rendered), "")
    return pairs.select("pair_id", F.col("n").alias("n_prompt_turns"), prompt.alias("prompt"), rest(F.col("c")).alias("chosen"), rest(F.col("r")).alias("rejected"))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def mask(segments: Column) -> Column:
    """The mask as text: characters and + (trained) or - of each segment."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.length(s["text"]).cast("string"), F.when(s["trained"], "+").otherwise("-"))), " ")


def last_reply_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: each, up to its last assistant turn, is chosen;
    with that reply replaced by the last one of its neighbour (conv_id with the lowest
    bit changed; empty where there is none) it is rejected."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    last = turns.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"))
    ends = last.select("conv_id", F.col("last.turn").alias("end")).join(other, "conv_id", "left")
    kept = turns.join(ends, "conv_id").where("turn <= end").withColumnRenamed("conv_id", "pair_id")
    swapped = (F.col("turn") == F.col("end")) & (F.col("role") == TRAINED_ROLE)
    rejected = kept.withColumn("text", F.when(swapped, F.coalesce("reply", F.lit(""))).otherwise(F.col("text")))
    return kept, rejected
