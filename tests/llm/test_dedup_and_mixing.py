"""Exact dedup, mixing and external shuffle against brute force, and their edge cases."""

import math
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import dedup_blocks, mixing
from pointloom.llm.common import materialize, word_count
from pointloom.llm.dedup_blocks import drop_copies, exact_dedup, name_documents
from pointloom.llm.external_shuffle import external_shuffle
from pointloom.llm.mixing import repeat_rows, source_targets, systematic_mix

DOCS = "doc_id long, text string, source string, kept string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ROWS = [(i, t, s, "x") for i, (t, s) in enumerate([("a", "s1"), ("a", "s1"), ("", "s2"), (None, None), ("b" * 50, "s2"), ("b" * 49 + "c", "s2"), ("b" * 50, None), ("ä b\nc", "s3"), ("ab" * 40, "s3"), ("ab" * 40, "s3"), ("ab" * 39, "s3"), (" ", "s3")])]


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_dedup_is_brute_force(spark, block):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, ROWS), block_chars=block).collect()}
    assert got == brute(ROWS)


def test_hot_blocks_are_joined_again(spark, monkeypatch):
    monkeypatch.setattr(name_documents, "__defaults__", (4096, 100))
    rows = [(i, "same text" if i % 3 else f"other {i}", "s", None) for i in range(3200)]
    got = exact_dedup(docs(spark, rows), block_chars=4)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.collect()} == brute(rows)


def test_dedup_keeps_one_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "t", "s", None), (5, "t", "s", None), (None, "t", "s", None), (None, "u", "s", None)]
    got = exact_dedup(docs(spark, rows)).collect()
    assert sum(r.kept for r in got if r.text == "t") == 1
    assert all(r.keep_id == 5 and r.group_size == 3 for r in got if r.text == "t")
    assert [r.kept for r in got if r.text == "u"] == [True]
    assert exact_dedup(docs(spark, [])).count() == 0


def test_dedup_of_a_shuffled_input(spark):
    df = docs(spark, ROWS).repartition(3, "source")
    assert {r.doc_id: r.kept for r in exact_dedup(df, block_chars=5).collect()} == {k: v[2] for k, v in brute(ROWS).items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n", max_size=9), min_size=1, max_size=12))
def test_dedup_of_any_texts(spark, texts):
    rows = [(i, t, "s", None) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, rows), block_chars=2).collect()}
    assert got == brute(rows)


def targets_by_rounds(sizes, weights):
    """The targets as the excess is handed on, round by round."""
    total, capped = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(capped.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            return [capped.get(i, share.get(i)) for i in range(len(sizes))]
        capped |= {i: 3 * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[100, 5, 60, 1, 500], [0, 10, 10], [7], [1, 1, 1000, 1], [33, 33, 33]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = targets_by_rounds(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))])
    assert all(math.isclose(got[f"s{i}"], w, rel_tol=1e-9, abs_tol=1e-9) for i, w in enumerate(want))


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4 if i % 10 else None}", None) for i in range(600)]
    one, two = (systematic_mix(docs(spark, rows), bucket_rows=50).collect() for _ in range(2))
    assert sorted((r.doc_id, r.copies) for r in one) == sorted((r.doc_id, r.copies) for r in two)
    assert all(r.size == len((rows[r.doc_id][1]).split()) and 0 <= r.copies <= 3 for r in one)
    for s in {r.source for r in one}:
        own = [r for r in one if r.source == s]
        each = own[0].target / own[0].source_size
        assert all(r.copies in (math.floor(each), math.ceil(each)) for r in own)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.03 * own[0].target
    again = repeat_rows(systematic_mix(docs(spark, rows), bucket_rows=50))
    assert again.columns == ["doc_id", "text", "source", "kept"] and again.count() == sum(r.copies for r in one)


def test_mix_of_empty_null_and_repeated_rows(spark):
    assert systematic_mix(docs(spark, [])).count() == 0
    got = systematic_mix(docs(spark, [(1, None, None, None), (1, None, None, None), (None, "a b", "s", None)])).collect()
    assert {(r.size, r.target, r.copies) for r in got if r.source is None} == {(0, 0.0, 0)}
    assert [(r.size, r.target, r.copies) for r in got if r.source == "s"] == [(2, 2.0, 1)]


def test_word_count_takes_ascii_blanks_only(spark):
    df = spark.createDataFrame([("a b c\td\n\x0b\x0c\re",), ("",), (" ",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [4, 0, 0]


def test_shuffle_is_whole_balanced_and_repeats(spark, tmp_path):
    rows = [(i, "é" * (i % 5), "s", str(i)) for i in range(403)] + [(None, None, None, None), (7, "éé", "s", "7")]
    runs = []
    for k, parts in enumerate((1, 5)):
        out = external_shuffle(docs(spark, rows).repartition(parts), str(tmp_path / f"o{k}"), 8, bucket_bytes=300)
        runs.append(out.collect())
    for got in runs:
        assert sorted(str((r.doc_id, r.text, r.kept)) for r in got) == sorted(str((i, t, k)) for i, t, _, k in rows)
        counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
        assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    key = lambda got: sorted((r.shard, r.slot, str(r.doc_id), zlib.crc32((r.text or "").encode())) for r in got)
    assert key(runs[0]) == key(runs[1])
    order = [r.doc_id for r in sorted(runs[0], key=lambda r: (r.shard, r.slot))]
    assert sum(a is not None and b is not None and abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 20
    assert external_shuffle(docs(spark, []), str(tmp_path / "none")).count() == 0


def reading_anew(monkeypatch, spark, module):
    """Every write is followed by another number of splits, as when executors come and go."""
    from pointloom.llm import common

    calls = []

    def write(df, name):
        out = materialize(df, name)
        calls.append(name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(3 + 5 * len(calls) % 13))
        return out

    for m in (module, common):
        monkeypatch.setattr(m, "materialize", write)
    return calls


@pytest.fixture
def in_files(spark, tmp_path):
    rows = [(i, f"text {i // 3 if i % 2 else i} " * (1 + i % 7), f"s{i % 3}", None) for i in range(900)]
    docs(spark, rows).repartition(6).write.parquet(str(tmp_path / "docs"))
    yield spark.read.parquet(str(tmp_path / "docs")), rows
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_dedup_holds_when_splits_change(spark, monkeypatch, in_files):
    table, rows = in_files
    calls = reading_anew(monkeypatch, spark, dedup_blocks)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(table, block_chars=8).collect()} == brute(rows)
    assert sorted(r.doc_id for r in drop_copies(table, block_chars=8).collect()) == sorted(i for i, v in brute(rows).items() if v[2])
    assert len(calls) > 5


def test_mix_holds_when_splits_change(spark, monkeypatch, in_files):
    table, rows = in_files
    calls = reading_anew(monkeypatch, spark, mixing)
    got = systematic_mix(table).collect()
    assert sorted(r.doc_id for r in got) == list(range(900)) and len(calls) > 2
    assert all(r.size == len(r.text.split()) for r in got)
