"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. Equal blocks get one integer name, and
then adjacent names are paired and the pairs named in turn, level by level, until each document has one
name. Names come from comparing the blocks and pairs themselves, never from a hash of them, so two
documents of one length have the same name exactly when their texts are the same.

Scale: texts cross the network once, to be sorted by block; everything later moves integers only.
A block that very many documents hold is spread over as many sorts as keep each below ``BLOCK_ROWS``, and the
local names it gets are joined into one afterwards. Which blocks are that frequent is found from counts by block
hash; the bound rises with the data only so far that there are at most ``MOST_HOT`` of them.

Rows are written once with their numbers, and everything after reads those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import broadcast_if_small, discard, materialize, numbered, text_or_empty

BLOCK_CHARS = 4096
#: Equal blocks that are sorted together at most; frequent blocks and their parts that are broadcast at most.
BLOCK_ROWS, MOST_HOT = 50_000, 100_000
#: Numbers of dropped rows that are broadcast at most.
BROADCAST_DROPPED = 1_000_000


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """One row per block: the row's id, its block number, the block; short texts skip the cutting."""
    size = F.length("_text")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / block_chars).cast("int") - 1)),
        lambda i: F.substring(F.col("_text"), i * block_chars + 1, F.lit(block_chars)),
    )
    whole = F.when(size <= block_chars, F.array("_text")).otherwise(cut)
    return docs.select("_row", size.alias("_chars"), F.posexplode(whole).alias("_pos", "_block"))


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Name every row of ``docs``: ``(_row, _chars, _name)``; ``docs`` must carry a unique ``_row`` and ``_text``.

    Rows have equal texts exactly when ``(_chars, _name)`` agree.
    """
    blocks = _blocks(docs, block_chars)
    counts = blocks.groupBy(F.xxhash64("_block").alias("_h")).agg(F.count("*").alias("_n"))
    counts = materialize(counts, "block-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    most = max(block_rows, total // MOST_HOT)
    hot = counts.where(F.col("_n") > most).select("_h", F.ceil(F.col("_n") / most).cast("int").alias("_salts"))
    any_hot = not hot.isEmpty()
    # Broadcast: each has more than one in MOST_HOT of all blocks.
    blocks = blocks.withColumn("_h", F.xxhash64("_block")).join(F.broadcast(hot), "_h", "left") if any_hot else blocks.withColumn("_salts", F.lit(None).cast("int"))
    is_hot = F.col("_salts").isNotNull()
    # Each block row has an integer of its own; the least among equal blocks, sorted together, names them all.
    sort = Window.partitionBy("_block", "_salt").orderBy("_id")
    named = (
        blocks.withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_salt", F.when(is_hot, F.pmod(F.hash("_row"), F.col("_salts"))).otherwise(F.lit(0)))
        .withColumn("_name", F.first("_id").over(sort))
        .select("_row", "_chars", "_pos", "_name", F.when(is_hot & (F.col("_name") == F.col("_id")), F.col("_block")).alias("_seen"))
    )
    named = materialize(named, "block-names")
    if any_hot:
        one = Window.partitionBy("_seen")
        local = named.where("_seen is not null").select("_name", F.min("_name").over(one).alias("_to"))
        # Broadcast: a row of two integers for each part, twice MOST_HOT at most.
        named = named.join(F.broadcast(local), "_name", "left").withColumn("_name", F.coalesce("_to", "_name"))
    named = named.select("_row", "_chars", "_pos", "_name")
    done = named.where(F.col("_chars") <= block_chars).select("_row", "_chars", "_name")
    rest = materialize(named.where(F.col("_chars") > block_chars), "names-0")
    width = rest.agg(F.max("_pos")).first()[0]
    level = 0
    while width:
        level += 1
        half = rest.groupBy("_row", "_chars", (F.col("_pos") / 2).cast("int").alias("_pos")).agg(
            F.min(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_left"), F.min(F.when(F.col("_pos") % 2 == 1, F.col("_name"))).alias("_right")
        )
        half = materialize(half.withColumn("_id", F.monotonically_increasing_id()), f"pairs-{level}")
        names = materialize(half.groupBy("_left", "_right").agg(F.min("_id").alias("_name")), f"pair-names-{level}")
        same = (half["_left"] == names["_left"]) & half["_right"].eqNullSafe(names["_right"])
        last, rest = rest, materialize(half.join(names, same).select("_row", "_chars", "_pos", "_name"), f"names-{level}")
        discard(last, half, names)  # nothing reads them any more
        width //= 2
    if level:
        done = done.union(rest.select("_row", "_chars", "_name"))
    return done


def _marks(rows: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """``(_row, keep_id, group_size, kept)`` of every row; ``rows`` has a unique ``_row``."""
    names = name_documents(rows.select("_row", text_or_empty(text_col).alias("_text")), block_chars)
    ids = materialize(names.join(rows.select("_row", F.col(id_col).alias("_id")), "_row"), "document-names")
    best = F.max(F.struct(F.coalesce(F.col("_id"), F.lit(-(2**63))).alias("v"), F.col("_row").alias("r")))
    groups = materialize(ids.groupBy("_chars", "_name").agg(best.alias("_best"), F.max("_id").alias("keep_id"), F.count("*").alias("group_size")), "document-groups")
    return ids.join(groups, ["_chars", "_name"]).select("_row", "keep_id", "group_size", (F.col("_best.r") == F.col("_row")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when identical; null counts as empty. The row with the largest id stays (null ids
    last; among rows that tie, one of them). Columns of ``docs`` with these three names, or with names
    that start with an underscore as used here, are replaced. Empty input gives an empty result.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "_row", "_text")
    rows = numbered(docs)
    return rows.join(materialize(_marks(rows, id_col, text_col, block_chars), "document-marks"), "_row").drop("_row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns (but ``_row`` and ``_text``).

    Only the numbers of dropped rows are joined: up to ``BROADCAST_DROPPED`` are broadcast, which spares the
    texts a second shuffle; beyond, texts are shuffled once more.
    """
    rows = numbered(docs.drop("_row", "_text"))
    dropped = _marks(rows, id_col, text_col, block_chars).where("NOT kept").select("_row")
    return rows.join(broadcast_if_small(dropped, BROADCAST_DROPPED), "_row", "left_anti").drop("_row")
