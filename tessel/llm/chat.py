"""Chat formatting with collapse of cumulative snapshots (operator 4), in DataFrame operations alone.

A conversation is often logged again after every turn. A hash of each prefix of turns (an XOR of hashes of turns,
each with its number) shows whether a conversation is a proper prefix of a longer one; anti-joins keep the maximal
ones, copies collapse to the least id, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns in a block of the two-level prefix sums.
BLOCK = 512


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(kept, rows)``: kept conversations ``conv, n_turns, n_copies``, and the turns of all, repeated rows once.

    A conversation is its set of distinct (turn, role, text) rows; a prefix ends at a turn number. Those equal to a
    proper prefix of another go; of equal ones the least known id stays. Rows without an id are conversations of one turn
    each; a turn that is null or no number comes first; turns that share a number stand together. ``conv`` is a struct
    that tells conversations apart, with the id as ``id``.
    """
    alone = F.when(F.col(conv_col).isNull(), F.xxhash64(F.col(turn_col).cast("string"), F.col(role_col).isNull(), role_col, F.col(text_col).isNull(), text_col)).otherwise(F.lit(0))
    conv = F.struct(F.col(conv_col).isNull().alias("none"), F.col(conv_col).alias("id"), alone.alias("row"))
    t = turns.select(conv.alias("conv"), F.coalesce(F.col(turn_col).try_cast("long"), F.lit(-(2**62))).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).distinct()
    steps = t.groupBy("conv", "turn").agg(F.bit_xor(_hash(1)).alias("a"), F.bit_xor(_hash(2)).alias("b"), F.count("*").alias("n"))
    blocked = steps.withColumn("block", F.floor(F.col("turn") / BLOCK))
    per_block = blocked.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    base = per_block.select(
        F.col("conv").alias("c"), F.col("block").alias("k"), F.coalesce(F.bit_xor("a").over(earlier), F.lit(0)).alias("a0"), F.coalesce(F.bit_xor("b").over(earlier), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("n").over(whole).alias("all"),
    )
    inside = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = blocked.select("conv", "block", F.bit_xor("a").over(inside).alias("ra"), F.bit_xor("b").over(inside).alias("rb"), F.sum("n").over(inside).alias("rn"))
    prefix = running.join(base, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("k"))).select(
        "conv", F.col("ra").bitwiseXOR(F.col("a0")).alias("a"), F.col("rb").bitwiseXOR(F.col("b0")).alias("b"), (F.col("rn") + F.col("n0")).alias("n"), "all"
    )
    full = prefix.where("n = all").groupBy("a", "b", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    proper = prefix.where("n < all").select("a", "b", "n").distinct()
    kept = full.join(proper, ["a", "b", "n"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies")
    return kept, t


def render_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, chat``: maximal conversations as one text each.

    Each turn is ``<|im_start|>role`` newline text ``<|im_end|>`` newline, in the order of turn, role and text. A null
    role is "unknown", a null text is empty. See ``maximal_conversations`` for rows without an id or a number. An empty table gives no rows. Other columns are not read.
    """
    kept, t = maximal_conversations(turns, conv_col, turn_col, role_col, text_col)
    of = kept.select(F.col("conv").alias("c"), "n_turns", "n_copies")
    rows = t.join(of, F.col("conv") == F.col("c"))
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", piece.alias("piece"))))
    chat = rows.groupBy("c", "n_turns", "n_copies").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("chat"))
    return chat.select(F.col("c.id").alias(conv_col), F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), "chat")
