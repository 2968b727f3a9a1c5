"""Labelled samples stay bounded when ids repeat, and null ids have a fold."""

import numpy as np

from pointloom.llm.rules import FEATURES, fit_rules, text_statistics
from pointloom.llm.subword import fit

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def test_repeated_ids_count_once(spark):
    good, bad = "a plain sentence of several words that differ each time", "buy buy buy now now now # # $ $"
    docs = [(i, (good if i % 2 else bad) + f" {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)
    once, often = spark.createDataFrame(docs, DOCS), spark.createDataFrame(docs + docs[:20] * 9 + [(None, good)], DOCS)
    assert np.array_equal(fit(once, labels), fit(often, labels))
    assert fit_rules(text_statistics(once), labels) == fit_rules(text_statistics(often), labels)
    assert FEATURES


def test_features_of_very_long_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 4000))) for i in range(12)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], LABELS)
    few, every = fit(docs, labels, max_bytes=200_000), fit(docs, labels)
    assert few.shape == every.shape and not np.array_equal(few, every)


def test_null_ids_have_a_fold(spark, tmp_path):
    from pointloom.llm.registry import op10_subword_quality

    spark.createDataFrame([(1, "one text"), (2, "another"), (None, "no id")], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"]: r["held_out"] for r in op10_subword_quality(spark, str(tmp_path)).collect()}[None] is False
