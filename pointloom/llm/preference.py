"""Preference formatting: one prompt and two masked completions per pair of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as the
prompt; what follows in each is a completion, of which only assistant content carries loss. A rendered
turn is one row with the span of its characters that is trained on, so conversations of any length
stay spread over rows; concatenated by ``turn`` and ``rank`` the rows of a part give its text.

Scale: turns of both sides meet in one aggregation by (pair, turn), the first difference in another;
both combine before the shuffle and no conversation is gathered in one row. Only turns that share a
conversation and a number are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import materialize

HEAD, NEXT, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
SIDES = ("chosen", "rejected")


def pairs_by_id(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations 2k and 2k + 1 as pair k, the even one chosen; one without partner is alone."""
    ids = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id")).distinct()
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return ids.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "conv_id")


def format_preferences(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows ``pair_id, part, turn, rank, role, rendered, train_from, train_to, paired``.

    ``pairs`` has ``pair_id``, ``side`` ('chosen' or 'rejected') and ``conv_id``. Turns are compared by
    number, role and text; null roles and texts count as empty, null numbers (-1) come first. Rows that
    repeat a turn of a side exactly count once; different ones of one number go by role, then text, which
    ``rank`` counts from 0. Several conversations on one side of a pair make one, of all their turns.
    ``train_from`` and ``train_to`` bound the trained characters of ``rendered`` (both 0 where nothing is).

    A pair has both completions always: a side with no turn after the prompt has one empty row, its turn,
    rank and role null. That holds for equal conversations and for a side without conversation, where
    ``paired`` is false and the other side is a completion as a whole. Empty input gives no rows.
    """
    t = turns.select(F.col(id_col).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sided = t.join(pairs.select("pair_id", "side", "conv_id"), "conv_id").select("pair_id", "side", "turn", "role", "text").distinct()
    rank = F.row_number().over(Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text")) - 1
    sided = sided.withColumn("at", F.struct("turn", rank.cast("long").alias("rank"))).withColumn("said", F.struct("role", "text"))
    of = lambda side: F.min(F.when(F.col("side") == side, F.col("said"))).alias(side)
    both = materialize(sided.groupBy("pair_id", "at").agg(*map(of, SIDES)), "preference-turns")
    differs = ~F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False))
    first = F.min(F.when(differs, F.col("at"))).alias("first")
    # Per pair: the first difference, and of each side whether it has turns and whether some follow the prompt.
    has = [F.max(F.col(s).isNotNull()).alias(f"has_{s}") for s in SIDES]
    last = [F.max(F.when(F.col(s).isNotNull(), F.col("at"))).alias(f"last_{s}") for s in SIDES]
    each = materialize(both.groupBy("pair_id").agg(first, *has, *last), "preference-pairs")
    paired = (F.col("has_chosen") & F.col("has_rejected")).alias("paired")
    part = lambda name, side: F.struct(F.lit(name).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))
    own = lambda side: F.when(F.col(side).isNotNull(), part(side, side))
    shared = F.col("first").isNull() | (F.col("at") < F.col("first"))
    parts = F.when(shared, F.array(part("prompt", "chosen"))).otherwise(F.filter(F.array(*map(own, SIDES)), lambda p: p.isNotNull()))
    rows = both.join(each, "pair_id").select("pair_id", "at.*", paired, F.explode(parts).alias("p")).select("pair_id", "turn", "rank", "paired", "p.*")
    head = F.concat(F.lit(HEAD), "role", F.lit(NEXT))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    rendered = F.concat(head, "text", F.lit(END))
    full = rows.select(
        "pair_id",
        "part",
        "turn",
        "rank",
        "role",
        rendered.alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).cast("long").alias("train_from"),
        F.when(trained, F.length(rendered)).otherwise(0).cast("long").alias("train_to"),
        "paired",
    )
    nothing = lambda side: F.when(~F.coalesce(F.col(f"last_{side}") >= F.col("first"), F.lit(False)), F.lit(side))
    empty = each.select("pair_id", paired, F.explode(F.filter(F.array(*map(nothing, SIDES)), lambda p: p.isNotNull())).alias("part"))
    null, zero = F.lit(None), F.lit(0).cast("long")
    empty = empty.select("pair_id", "part", null.cast("long").alias("turn"), null.cast("long").alias("rank"), null.cast("string").alias("role"), F.lit("").alias("rendered"), zero.alias("train_from"), zero.alias("train_to"), "paired")
    return full.union(empty)
