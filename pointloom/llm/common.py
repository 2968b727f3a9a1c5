"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.storage import broadcast_if_small, discard, materialize, shared_path

__all__ = ["broadcast_if_small", "discard", "materialize", "shared_path"]

#: Words are runs of anything but the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, name: str = "numbered") -> DataFrame:
    """``docs``, written once with a number ``_row`` for each row, which holds however often it is read.

    A place of reading must not name rows: it follows the splits of a scan, and those follow the executors at
    hand, so two jobs over one table may number its rows differently.
    """
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), name)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs that run inside, for rows of whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hashed_sample(rows: DataFrame, most: int, *ids: str) -> DataFrame:
    """At most ``most`` of ``rows``, those first in order of a hash of ``ids``.

    A threshold from the count goes first, so that only about so many rows are ever sorted or sent.
    """
    count, parts = rows.count(), 1 << 30
    h = F.xxhash64(*ids)
    if count > most:
        share = min(1.0, most / count + 4 * (most**0.5 + 1) / count)
        rows = rows.where(F.pmod(h, F.lit(parts)) < int(share * parts))
    return rows.orderBy(F.pmod(h, F.lit(parts)), *ids).limit(most)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.length(F.regexp_replace(marks, BLANKS, "")).cast("long")


def few_tasks(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df`` of about ``rows`` small rows in as many tasks as they need, whatever its shuffles deal."""
    return df.coalesce(max(4, -(-rows // per_task)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star rounds.

    Returns ``(node, comp)`` for every node that has an edge; ``comp`` is the smallest node reachable.
    Each round is two aggregations with map-side combine and two joins; nothing reaches the driver
    but one row of totals. Empty input gives no rows; self-loops and repeated edges have no effect.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        totals = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if totals == seen or not totals[0]:
            break
        seen, few = totals, lambda df, n=totals[0]: few_tasks(df, 2 * n)
        both = e.union(e.select("v", "u"))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.where("v > u").join(least, "u").where("v <> m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.distinct())
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low))
        before, e = e, materialize(few(small.distinct()), "small-star")
        discard(before)
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return ends.union(few_tasks(e.select(F.col("v"), F.col("v")).distinct(), totals[0]))
