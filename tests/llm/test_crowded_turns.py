"""Preference formatting: very many turns of one number, large numbers, several conversations on a side."""

from pyspark.sql import functions as F

from pointloom.llm import preference

MANY = 65_536 + 3
KIND = "conv_id long, turn long, role string, text string"


def test_no_turn_of_a_crowded_number_is_lost(spark):
    crowd = spark.range(MANY).select(F.lit(0).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lpad(F.col("id").cast("string"), 8, "0").alias("text"))
    rest = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (2, 0, "user", "x"), (3, 0, "user", "x")], KIND)
    turns = crowd.union(crowd.withColumn("conv_id", F.lit(1).cast("long"))).union(rest)
    got = preference.format_preferences(turns, preference.pairs_by_id(turns)).collect()
    of = lambda pair, part: sorted((r.turn, r.rank, r.rendered) for r in got if r.pair_id == pair and r.part == part and r.role is not None)
    assert of(0, "prompt") == [(-1, i, f"<|user|>\n{i:08d}<|end|>\n") for i in range(MANY)] + [(0, 0, "<|user|>\nq<|end|>\n")]
    assert of(0, "chosen") == [(1, 0, "<|assistant|>\na<|end|>\n")] and of(0, "rejected") == [(1, 0, "<|assistant|>\nb<|end|>\n")]
    assert of(1, "prompt") == [(0, 0, "<|user|>\nx<|end|>\n")]


def test_large_numbers_clashing_columns_and_several_conversations_on_a_side(spark):
    rows = [(1, 2**50, "assistant", "better"), (2, 2**50, "assistant", "good"), (3, 2**62, "assistant", "bad"), (None, 1, "user", "without id")]
    turns = spark.createDataFrame([(*r, "x", 7) for r in rows], KIND + ", pair_id string, rank int")
    pairs = spark.createDataFrame([(9, "chosen", 1), (9, "chosen", 2), (9, "rejected", 3)], "pair_id long, side string, conv_id long")
    got = sorted((r.part, r.turn, r.rank, r.rendered) for r in preference.format_preferences(turns, pairs).collect())
    say = lambda t: f"<|assistant|>\n{t}<|end|>\n"
    assert got == [("chosen", 2**50, 0, say("better")), ("chosen", 2**50, 1, say("good")), ("rejected", 2**62, 0, say("bad"))]
