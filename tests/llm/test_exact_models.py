"""The classifier's score, its tokens and the shuffle's order against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import rules, subword
from pointloom.llm.external_shuffle import external_shuffle
from pointloom.llm.mixing import systematic_mix


def texts(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def bag(text):
    return np.sort(np.concatenate([np.asarray(t, np.int64) for t in subword.token_ids(text)]))


def test_tokens_do_not_depend_on_where_texts_are_cut(monkeypatch):
    rng = np.random.default_rng(1)
    many = ["", "a", "ab", " ab  cd\té x", "".join(rng.choice(list("abc \né"), 500))]
    whole = [bag(t) for t in many]
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(subword, "_CHUNK", chunk)
        assert all((bag(t) == w).all() for t, w in zip(many, whole, strict=True))


def test_score_is_softmax_of_the_mean_vector(spark):
    rng = np.random.default_rng(2)
    vectors, layer, bias = rng.normal(size=(subword.TOKENS, 4)), rng.normal(size=(4, 2)) * 5, rng.normal(size=2)
    model = np.append(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])
    rows = [(1, "some words here here", "x"), (2, None, "y"), (3, "é" * 50, None), (3, "é" * 50, None)]
    got = subword.score(texts(spark, rows, ", _text string"), model).collect()
    assert [r._text for r in got] == [r[2] for r in rows]
    for r in got:
        z = vectors[bag(r.text)].mean(0) @ layer + bias
        assert np.isclose(r.score, np.exp(z[1]) / np.exp(z).sum(), atol=1e-4)


def test_a_document_with_both_labels_counts_once_as_the_lower(spark):
    docs = texts(spark, [(i, f"{'good fine words' if i % 2 else 'junk spam junk'} {i}") for i in range(60)])
    once = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    twice = once.union(once.where("quality = 0").withColumn("quality", F.lit(1))).union(once)
    assert (subword.fit(docs, once) == subword.fit(docs, twice)).all()
    stats = rules.text_statistics(docs.withColumn("n_words", F.lit("x")).withColumn("_h", F.lit(1)))
    assert rules.fit_rules(stats, once) == rules.fit_rules(stats, twice)
    assert stats.schema["n_words"].dataType.simpleString() == "bigint"
    assert rules.text_statistics(texts(spark, [])).count() == 0


def test_shuffle_is_the_plain_two_passes(spark, tmp_path):
    """Bucket by bucket: rows in canonical order, then numpy's Fisher-Yates with the bucket's seed."""
    rows = [(i % 90, f"t{i % 70}", i, i) for i in range(400)] + [(5, "x" * 200_000, 0, 0)]
    docs = texts(spark, rows, ", slot long, extra long")
    got = external_shuffle(docs, str(tmp_path / "o"), 8, seed=29, bucket_bytes=20_000).collect()
    plain = docs.drop("slot").withColumn("tie", F.xxhash64("doc_id", "text", "extra"))
    buckets = len({r.bucket for r in got})
    total = 200_001 + sum(len(r[1]) + 1 for r in rows[:-1])
    of = plain.withColumn("b", F.pmod(F.xxhash64(F.lit(29), "doc_id", "tie"), F.lit(-(-total // 20_000)))).collect()
    want = []
    for b in sorted({r.b for r in of}):
        own = sorted((r for r in of if r.b == b), key=lambda r: (r.doc_id, r.tie))
        places = np.arange(len(own))
        np.random.Generator(np.random.PCG64([29, b])).shuffle(places)
        want += [(own[p].doc_id, own[p].text, own[p].extra) for p in places]
    assert [(r.doc_id, r.text, r.extra) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == want
    assert buckets > 3 and [r.shard for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [k * 8 // 401 for k in range(401)]


def test_mixing_crosses_one_boundary_per_copy(spark):
    """Prefix sums in the stated order give copies that differ from the running expectation by less than one."""
    rows = [(i, "w " * (1 + i * 13 % 97), f"s{i % 3}", i, i) for i in range(900)] + [(1000, "w " * 100_000, "s0", 1, 1)]
    docs = texts(spark, rows, ", source string, _row long, copies long")
    got = systematic_mix(docs, bucket_rows=40).collect()
    assert len(got) == 901 and got[0].__fields__[:3] == ["doc_id", "text", "source"] and all(r.copies is not None for r in got)
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == s]
        each = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - each * len(own)) < 1 + 1e-6
        for lo in (1, 2, 4, 8, 16, 32, 64):  # and so in every class of sizes
            part = [r for r in own if lo <= r.size + 1 < 2 * lo]
            assert abs(sum(r.copies for r in part) - each * len(part)) < 1 + 1e-6
