"""Preference formatting of chosen and rejected conversations.

Two conversations of a pair share a prompt: their longest common prefix of
turns, rendered once. What follows in each is rendered as its completion,
with a mask of the code-point ranges to train on: the texts of assistant
turns and their end marks. Everything else in a completion is masked.

A turn is rendered as ``<|role|>``, a line end, the text, ``<|end|>`` and a
line end; ``<|`` inside a text becomes ``< |``, so marks can't be forged.

Rows are dealt by pair once; running lengths come from a window over the
turns of a side, so a conversation of many turns costs no more per turn.

Defined results: turns are ordered by (turn, role, text), nulls first, and
repeated rows stay; a null role is ``none`` and a null text empty; a pair
with one side only has no prompt and an empty other completion; a row with a
null pair_id is a pair of its own, of one turn, whose pair_id is null; a null
``rejected`` counts as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

END = "<|end|>\n"


def completion(turns: str, rest: Column) -> Column:
    """struct<text, mask>: the rendered turns of ``rest`` and the trained ranges as start:end, comma-joined."""
    before = F.coalesce(F.get(F.col(turns), F.col("n_prompt") - 1)["to"], F.lit(0))
    trained = F.filter(rest, lambda t: t["role"] == "assistant")
    mask = F.array_join(F.transform(trained, lambda t: F.concat_ws(":", t["to"] - F.char_length(t["body"]) - before, t["to"] - before)), ",")
    return F.struct(rendered(rest).alias("text"), mask.alias("mask"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def preference_format(turns: DataFrame) -> DataFrame:
    """From turns (pair_id, rejected boolean, turn, role, text) to one row per pair:
    pair_id, n_prompt, n_chosen, n_rejected (turns), prompt, chosen, chosen_mask, rejected, rejected_mask."""
    lone = F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id())
    told = turns.select("pair_id", lone.alias("lone"), F.coalesce("rejected", F.lit(False)).alias("side"), "turn", "role", "text").repartition("pair_id", "lone")
    order = W.partitionBy("pair_id", "lone", "side").orderBy("turn", "role", "text")
    role = F.coalesce("role", F.lit("none"))
    told = told.withColumns(
        {
            "head": F.concat(F.lit("<|"), role, F.lit("|>\n")),
            "body": F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END)),
            "i": F.row_number().over(order),
        }
    )
    told = told.withColumn("to", F.sum(F.char_length("head") + F.char_length("body")).over(W.partitionBy("pair_id", "lone", "side").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    turn = F.struct("i", "to", "role", "head", "body")
    sides = told.groupBy("pair_id", "lone").agg(F.array_sort(F.collect_list(F.when(~F.col("side"), turn))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("side"), turn))).alias("r"))
    same = F.aggregate(
        F.zip_with("c", "r", lambda c, r: F.coalesce((c["head"] == r["head"]) & (c["body"] == r["body"]), F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("going")),
        lambda a, equal: F.struct((a["n"] + F.when(a["going"] & equal, 1).otherwise(0)).alias("n"), (a["going"] & equal).alias("going")),
        lambda a: a["n"],
    )
    cut = sides.withColumn("n_prompt", same)
    rest = {side: F.expr(f"slice({side}, n_prompt + 1, size({side}))") for side in "cr"}
    done = cut.select(
        "pair_id",
        "n_prompt",
        (F.size("c") - F.col("n_prompt")).alias("n_chosen"),
        (F.size("r") - F.col("n_prompt")).alias("n_rejected"),
        rendered(F.expr("slice(c, 1, n_prompt)")).alias("prompt"),
        completion("c", rest["c"]).alias("cc"),
        completion("r", rest["r"]).alias("rr"),
    )
    return done.select("pair_id", "n_prompt", "n_chosen", "n_rejected", "prompt", F.col("cc.text").alias("chosen"), F.col("cc.mask").alias("chosen_mask"), F.col("rr.text").alias("rejected"), F.col("rr.mask").alias("rejected_mask"))


def with_foreign_reply(conversations: DataFrame) -> DataFrame:
    """Preference turns for ``preference_format`` from conversations (conv_id bigint, turn, role, text) that have no labels.

    Every conversation is the chosen side of a pair with its own id. The
    rejected side has the same turns, but its last assistant turn has the text
    of the last assistant turn of the conversation whose id is next to its
    own (the other of 2k and 2k + 1): a fluent reply to something else. Where
    that one has none, or this one has none, the rejected side has no such
    turn. Rows with a null conv_id have no rejected side.
    """
    known = conversations.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = F.when(F.col("role") == "assistant", F.struct(F.struct("turn", "role", "text").alias("order"), F.col("text").alias("text")))
    last = known.groupBy("pair_id").agg(F.max(reply).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("other"), F.col("last").isNotNull().alias("has_other"))
    marked = known.join(last.select("pair_id", F.col("last.order.turn").alias("last_turn"), F.col("last").isNotNull().alias("has_last")).join(other, "pair_id", "left"), "pair_id")
    final = F.col("has_last") & (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("last_turn"))
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text", F.lit(False).alias("rejected"))
    kept = marked.where(~F.coalesce(final, F.lit(False))).select("pair_id", "turn", "role", "text", F.lit(True).alias("rejected"))
    swapped = marked.where(final & F.coalesce("has_other", F.lit(False))).select("pair_id", "turn", "role", F.col("other").alias("text"), F.lit(True).alias("rejected"))
    return chosen.unionByName(kept).unionByName(swapped)
