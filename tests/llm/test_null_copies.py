"""Similarity join: copies with a null id that come before those with one."""

import random

from pointloom.llm import parity_join


def test_a_null_copy_first_in_its_partition_takes_no_links(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, want = [], {}
    for i in range(10):
        text = [rng.choice(words) for _ in range(120)]
        near = " ".join([*text[:-1], "other"])
        rows += [(None, " ".join(text)), (10 + 2 * i, " ".join(text)), (11 + 2 * i, near)]
        want |= {10 + 2 * i: 10 + 2 * i, 11 + 2 * i: 10 + 2 * i}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = parity_join.jaccard_components(docs, k=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 10
