"""Two-pass external shuffle into shards.

Pass one scatters records over buckets by a seeded hash, so that each holds about ``bucket_bytes``; pass
two loads a bucket, applies a seeded Fisher-Yates permutation and writes it. A record's position is the
number of records in earlier buckets plus its place in its own; shards are equal runs of positions, so
their row counts are at most one apart.

Scale: one task holds one bucket, whose size doesn't grow with the data. The number of buckets does;
their counts are one small row each. Hashes take the id and the whole row, so rows without an id spread too,
and copies of a text under different ids do not meet. Only rows that are the same share a bucket by force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import materialize, text_or_empty

BUCKET_BYTES = 32 << 20
#: Tasks of the second pass at most; beyond, a task takes buckets one after the other.
MAX_TASKS = 100_000
#: Bucket offsets are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_BUCKETS = 100_000


def _permute(seed: int, sort_by: tuple[str, ...]):
    def run(table: pa.Table) -> pa.Table:
        # A canonical order first: what the bucket got over the network in any order gives one result.
        order = table.sort_by([(c, "ascending") for c in sort_by])
        bucket = table.column("_bucket")[0].as_py()
        rng = np.random.Generator(np.random.PCG64([seed, bucket]))
        places = np.arange(len(table))
        rng.shuffle(places)  # Fisher-Yates
        return order.take(pa.array(places)).append_column("_place", pa.array(np.arange(len(table)), pa.int64()))

    return run


def external_shuffle(docs: DataFrame, path: str, shards: int = 8, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows and columns of ``docs`` under ``path``, one folder per shard, and return them as read back.

    Adds ``bucket``, ``shard`` and ``slot`` (the place within the shard, gapless from 0); such columns
    of ``docs`` are replaced. Rows with null ids or texts are kept. Rows of one id go by a hash of all their
    columns (maps apart), so reruns agree up to rows that are the same. Empty input writes an empty table.
    ``docs`` is read more than once and must give the same rows each time, in any order, as tables do.
    """
    docs = docs.drop("bucket", "shard", "slot", "_bucket", "_place", "_tie")
    size = F.octet_length(text_or_empty(text_col)) + 1
    total = docs.agg(F.sum(size), F.count("*")).first()
    buckets, rows = max(1, -(-(total[0] or 0) // bucket_bytes)), total[1]
    tie = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    marked = docs.withColumn("_tie", tie).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), "_tie"), F.lit(buckets)))
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = materialize(counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "bucket-starts")
    schema = T.StructType([*marked.schema.fields, T.StructField("_place", T.LongType())])
    # As many partitions as buckets, else tasks would take more of them as the data grows.
    dealt = marked.repartition(min(buckets, MAX_TASKS), "_bucket")
    mixed = dealt.groupBy("_bucket").applyInArrow(_permute(seed, (id_col, "_tie")), schema)
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    at = F.col("_start") + F.col("_place")
    placed = mixed.join(starts, "_bucket").withColumn("_at", at).withColumn("shard", F.expr(f"CAST(_at * {shards} DIV {max(rows, 1)} AS INT)"))
    first = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}) DIV {shards}")  # the first position of the shard
    placed = placed.withColumn("slot", F.col("_at") - first).withColumnRenamed("_bucket", "bucket").drop("_start", "_place", "_at", "_tie")
    placed.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)
