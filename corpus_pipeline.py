"""The corpus pipeline: quality classifier, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import discard, materialize, read_table
from pointloom.llm.dedup_blocks import drop_copies
from pointloom.llm.mixing import repeat_rows, systematic_mix
from pointloom.llm.packing import pack
from pointloom.llm.parity_join import BROADCAST_IDS, jaccard_components
from pointloom.llm.subword import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of an Arrow batch in the stages that run Python: rows are whole texts, and a worker holds a few batches.
ARROW_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """For the session from here on, since a stage's rows are computed when they are written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels, of whatever fold."""
    _small_batches(spark)
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles connect, the one with the smallest id stays."""
    _small_batches(spark)
    found = jaccard_components(docs, k=5, percent=80)
    dropped = materialize(found.where("component_id <> doc_id").select("doc_id"), "near-copies")
    # Few enough ids are broadcast, which spares the texts a shuffle.
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat as often as the mix takes them."""
    return repeat_rows(systematic_mix(docs.select(*COLUMNS))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths."""
    _small_batches(spark)
    return pack(docs)


#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Learned and sampled stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
            if before is not None:
                discard(before)  # what the stage before wrote is read
            before = docs
    return docs
