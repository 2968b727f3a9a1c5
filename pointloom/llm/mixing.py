"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Along an
order of the source's documents the expected copies are prefix-summed, one random offset is added, and
a document is emitted once for each integer boundary that its interval crosses: the floor or the ceiling
of what is expected, and never more in total than one boundary off. The order is by class of size and
within a class by a seeded hash, so that any stretch of it holds like sizes and the words taken come near
the target whatever the offset.

Scale: a class of size is dealt over buckets of a bounded number of documents, so no source is ever
sorted in one task; the prefix over a source adds up bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import broadcast_if_small, materialize, numbered, text_or_empty, word_count

BUCKET_ROWS = 500
#: Rows whose five numbers are broadcast at most, which spares the documents a shuffle; beyond, they take one.
BROADCAST_COPIES = 500_000
#: Classes of size to each doubling; a long size has 63 doublings, so there are at most 64 times as many.
CLASSES = 4
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size)`` plus ``weight`` and ``target``.

    Sources in code point order, null last, take the weights in turn and share the whole size by weight.
    No target exceeds ``max_copies`` times its source's size; the excess goes to the others by weight
    until none is above. In closed form: in order of limit per unit of weight the limited sources are a
    prefix, so running sums give the common level of the rest. Only one row per source meets here.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    one = sizes.withColumn("weight", F.array(*map(F.lit, weights))[(order % len(weights)).cast("int")])
    one = one.withColumn("_limit", F.col("source_size") * max_copies)
    by = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / (weight - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    one = one.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_limit"))
    # The level of the first source that is not limited holds for all after it.
    common = F.min(F.when(F.col("_free"), F.struct(F.col("_limit") / F.col("weight"), F.col("_level")))).over(everything)["_level"]
    target = F.when(F.col("_free"), common * F.col("weight")).otherwise(F.col("_limit").cast("double"))
    return one.withColumn("target", target).select("source", "source_size", "weight", "target")


def systematic_mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``size``, ``source_size``, ``target``, ``copies``.

    ``size`` is the number of words unless given; null text has none. Null sources form one source.
    Sources of size 0 have target 0 and no copies. Equal rows are told apart by their place in the
    input; reruns over the same table agree. Columns with the added names are replaced, one named ``_row``
    too; empty input gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "_row")
    rows = numbered(docs)
    size = word_count(text_or_empty()) if size is None else size
    slim = rows.select("_row", F.col(source_col).alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"))
    slim = slim.withColumn("_class", F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int"))
    slim = materialize(slim, "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes), "mix-targets").alias("t")
    counts = {r[0]: r[1] for r in slim.groupBy("_class").count().collect()}  # 64 * CLASSES rows at most
    buckets = F.array(*(F.lit(-(-counts.get(i, 0) // bucket_rows)) for i in range(max(counts, default=0) + 1)))
    slim = slim.withColumn("_bucket", F.pmod(F.xxhash64("_h", "_row"), F.get(buckets, F.col("_class"))))
    counts = slim.groupBy("source", "_class", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").alias("s")
    same = lambda a, b, *keys: [a["source"].eqNullSafe(b["source"]), *(a[k] == b[k] for k in keys)]
    place = F.row_number().over(Window.partitionBy("source", "_class", "_bucket").orderBy("_h", "_row"))
    ranked = slim.withColumn("_place", place)
    ranked = ranked.join(start, same(ranked, start, "_class", "_bucket")).select(ranked["*"], start["_start"])
    ranked = ranked.join(targets, same(ranked, targets)).select(ranked["*"], targets["source_size"], targets["target"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Copies: integer boundaries between the prefix sums before and after the document, moved by the offset.
    end = F.col("_start") + F.col("_place")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 20)) / float(1 << 20)
    copies = (F.floor(end * F.col("_each") + F.col("_u")) - F.floor((end - 1) * F.col("_each") + F.col("_u"))).cast("long")
    taken = ranked.withColumn("_each", each).withColumn("_u", offset).select("_row", "size", "source_size", "target", copies.alias("copies"))
    return rows.join(broadcast_if_small(taken, BROADCAST_COPIES), "_row").drop("_row")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as many times as ``copies`` says; the four added columns go."""
    times = F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1L, copies) ELSE array() END"))
    return mixed.withColumn("_copy", times).drop("_copy", "size", "source_size", "target", "copies")
