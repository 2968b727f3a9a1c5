"""Similarity join, rules, classifier, personal data, secrets, packing, preferences, pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import packing, parity_join, pii, preference, registry, rules, secrets, subword
from pointloom.llm.common import components
from pointloom.llm.words import shingle_set, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# --- similarity join


def test_word_hashes_follow_words():
    a = word_hashes("Ab  cd\tab\x0bAb é x".encode())
    assert len(a) == 5 and a[0] == a[3] and len(set(a.tolist())) == 4
    long = (b"x" * 3_000_000) + b" y " + b"z w " * 400_000
    assert len(word_hashes(long)) == 800_002 and len(np.unique(word_hashes(long))) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (60, 100), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 60: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = {x: a if c == b else c for x, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def variants(seed, n, near):
    """Random texts, and edits of a few of them: single ones far apart, and ones that cluster in the end."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 30, 80, 200, 400]))) for _ in range(n)]
    for _ in range(near):
        w = rng.choice(out).split()
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(vocab) for _ in range(max(1, len(w) * rng.choice([1, 5, 10, 15, 18]) // 100))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_join_is_brute_force(spark, k, percent):
    rows = [(i * 3 % 1009, t) for i, t in enumerate(variants(k, 120, 260))] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b C d e f g h"), (2004, "a B c D e f g h")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(texts(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_pairs_at_the_limit_share_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 85, 60):
        for n in (5, 6, 7, 13, 40, 111, 300):
            for _ in range(40):
                base = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
                # The largest difference that still links, split at random between both sides.
                both = n
                extra = both * (100 - percent) // percent
                left = int(rng.integers(0, extra + 1))
                a, b = np.sort(base[: both + left]), np.sort(np.concatenate([base[:both], base[both + left : both + extra]]))
                assert 100 * both >= percent * (both + extra)
                known = parity_join.bands(percent, 10_000)
                if len(a) == len(b) and (a == b).all():
                    continue
                keys = [set(parity_join._keys_of(x, percent, known).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
                d = parity_join.hamming(parity_join.short_sketch(a), parity_join.short_sketch(b))
                assert d <= extra


def test_join_with_nulls_repeats_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    chain, rows = list(base), []
    for i in range(40):  # each a step from the one before, so that a group's ends don't link
        chain = list(chain)
        chain[rng.randrange(60)] = f"n{i}"
        rows.append((i + 1, " ".join(chain)))
    rows += [(1, rows[0][1]), (None, rows[0][1]), (None, None), (90, " ".join(base[::-1]))]
    got = parity_join.jaccard_components(texts(spark, rows), 4, 70).collect()
    want = brute_components([r for r in rows[:40]] + [rows[-1]], 4, 70)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None, None] and len(got) == len(rows)
    assert parity_join.jaccard_components(texts(spark, [])).count() == 0


# --- rules


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered, seen, dup = collections.Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_statistics_are_brute_force(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "a " * 8), (3, "a " * 9), (4, "x\n\nx\n x\nx"), (5, "é#|<> b")]
    rows += [(10 + i, "".join(rng.choice(["a ", "b ", "c\n", "É$ ", "\t"]) for _ in range(rng.randrange(120)))) for i in range(60)]
    got = rules.text_statistics(texts(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute_statistics(t) for i, t in rows}


def test_rules_find_thresholds_and_keep_the_rest(spark):
    rng = np.random.default_rng(2)
    x = {f: rng.uniform(0, 1, 900) for f in rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["bang_share"] > 0.6))
    found = rules.learn_rules(x, bad)
    out = np.zeros(900, bool)
    for r in found:
        out |= rules._covers(r, x, 900)
    assert (out == bad).mean() > 0.9 and (out & ~bad).mean() < 0.02
    assert rules.learn_rules({f: np.zeros(0) for f in rules.FEATURES}, np.zeros(0, bool)) == []
    df = spark.createDataFrame([tuple(float(x[f][i]) for f in rules.FEATURES) for i in range(50)], list(rules.FEATURES))
    assert [r.keep for r in df.select(rules.decision_list(found).alias("keep")).collect()] == (~out[:50]).tolist()


def test_rules_without_labels_keep_all(spark):
    s = rules.text_statistics(texts(spark, [(1, "word " * 5 + " ".join(f"u{i}" for i in range(30)))]))
    assert rules.apply_rules(s, rules.fit_rules(s, spark.createDataFrame([(1, None)], "doc_id long, quality int"))).first().kept


# --- classifier


def test_classifier_holds_out(spark):
    x = {r.doc_id: r for r in registry.op10_subword_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in x.items() if r.held_out and i in labels]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == (r.predicted == 1) for r in x.values())


def test_classifier_of_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x " * 300_000, "c"), (4, "é", "d")]
    model = np.random.default_rng(0).normal(size=subword.TOKENS + 1)
    got = subword.score(texts(spark, rows, ", score string"), model).collect()
    assert len(got) == 4 and got[0].score == got[1].score
    assert subword.score(texts(spark, []), model).count() == 0
    nothing = subword.fit(texts(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert subword.score(texts(spark, [(1, "a")]), nothing).first().score == 0.5


def test_long_texts_are_scored_whole():
    text = "ab cd " * 250_000
    whole = sum(len(t) for t in subword.token_ids(text))
    assert whole > 2 * len(text) * 0.5 and sum(len(t) for t in subword.token_ids(text + "zz")) > whole


# --- personal data


PATTERNS = (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE))


def _plain(t):
    out = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 14 <= len(digits) <= 19 and pii.luhn(digits)
            elif kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "@@", ".", "x-1", " ", "+", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "+1 (499) 555-6503", "é", "%", "\n", "-", "(", "a@b.co", "000"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == _plain(t), t


def test_more_personal_data_is_added_and_base_stays(spark):
    rows = [(i, f"word call phone (499) 555-{6500 + i} or ssn 123-45-{6700 + i}, mail me@x{i}.org") for i in range(40)] + [(100, None), (101, ""), (102, "id 1234-56-78 nothing")]
    got = {r.doc_id: r for r in pii.find_personal_data(texts(spark, rows)).select("doc_id", "base", pii.joined(F.col("spans")).alias("s")).collect()}
    assert "phone_local:16:30" in got[0].s and "ssn:38:49" in got[0].s and "email:56:65" in got[0].s
    assert got[100].s == got[101].s == got[102].s == ""
    assert pii.find_personal_data(texts(spark, [])).count() == 0
    odd = texts(spark, rows).withColumn("base", F.lit(1)).withColumn("id", F.lit(2)).withColumn("spans", F.lit(3))
    assert {r.doc_id: r.s for r in pii.find_personal_data(odd).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()} == {i: r.s for i, r in got.items()}
    digest = registry.op1_weak_supervision_pii(spark, SF)
    want = {r.doc_id: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in _plain(r.text or "")).encode()).hexdigest() for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    assert {r.doc_id: r.base_sha256 for r in digest.collect()} == want


def test_em_tells_reliable_labelers_apart():
    patterns = {"ssn|+0++|ss": 80, "ssn|+00-|ss": 5, "ssn|-0-0|ww": 60, "ssn|-0--|ww": 50, "ssn|+0-0|ww": 3}
    likely, right = pii.estimate_reliabilities(patterns)
    assert likely["ssn|+0++|ss"] > 0.9 and likely["ssn|-0--|ww"] < 0.1 and right[0] > 0.8
    assert pii.estimate_reliabilities({})[0] == {}


def test_classifier_follows_likelihoods_by_its_own_features():
    yes, no = [[1, 2, 3], [1, 2, 4]], [[5, 6, 3], [5, 6, 4]]
    w = pii.train_span_classifier(yes * 20 + no * 20, [0.95] * 40 + [0.05] * 40)
    p = pii.span_scores(w, [*yes, *no, [1, 2], [5, 6]])
    assert all(p[[0, 1, 4]] > 0.8) and all(p[[2, 3, 5]] < 0.2)
    f = [3, 9, 77]
    assert np.isclose(pii.span_scores(w, [f])[0], 1 / (1 + np.exp(-(w[3] + w[9] + w[77] + w[pii.WIDTH]))))
    assert not pii.train_span_classifier([], []).any() and len(pii.span_scores(w, [])) == 0


# --- secrets


def test_forest_holds_out():
    labelled = secrets.labelled_findings(2000, 99)
    x, y = np.array([secrets.features(t, a, b, p) for t, a, b, p, _ in labelled]), np.array([r[-1] for r in labelled])
    assert ((secrets.forest_scores(secrets.default_forest(), x) >= 0.5) == y).mean() > 0.97


def test_secrets_are_found_and_digests_left(spark):
    rows = [(1, 'x token = "1eb9c654e721b4f812088970e66a6345cee33dd6" y'), (2, "commit 1eb9c654e721b4f812088970e66a6345cee33dd6 fixed"), (3, None), (4, ""), (4, "plain words only 12345")]
    got = [(r.doc_id, r.n_secrets, [(s.start, s.end) for s in r.secrets]) for r in secrets.scan_secrets(texts(spark, rows)).orderBy("doc_id").collect()]
    assert got[0] == (1, 1, [(11, 51)]) and all(n == 0 for _, n, _ in got[1:]) and len(got) == 5
    assert secrets.scan_secrets(texts(spark, [])).count() == 0


# --- packing


def test_bins_hold_all_pieces_once(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 60, 300, 1000])) for i in range(300)] + [(7, "w w"), (None, "w"), (8, None)]
    sizes = collections.Counter()
    for i, t in rows:
        sizes[i] += len((t or "").split())
    bins = packing.pack(texts(spark, rows), (64, 128, 256), group_pieces=100).collect()
    held = collections.Counter()
    for b in bins:
        assert b.used == sum(b.sizes) <= b.capacity and not any(b.used <= c < b.capacity for c in (64, 128, 256))
        for i, s, n in zip(b.doc_ids, b.starts, b.sizes, strict=True):
            held[i] += n
            assert n <= 256 and s % 256 == 0
    assert held == +sizes and len({b.bin_id for b in bins}) == len(bins)
    assert sum(b.used for b in bins) / sum(b.capacity for b in bins) > 0.95
    assert packing.pack(texts(spark, [])).count() == 0


def test_several_lengths_cost_no_more_than_one():
    sizes = np.random.default_rng(5).integers(1, 4097, 3000)
    best = sum(map(packing.cost, packing.pack_group(sizes)[2]))
    order = np.argsort(-sizes, kind="stable")
    assert best <= min(packing.best_fit(sizes[order], (4096,), (4096,))[2], packing.best_fit(sizes[order], packing.LENGTHS, packing.LENGTHS)[2])


def test_packed_texts(spark):
    long = " ".join(f"x{i}" for i in range(1_000_000))
    rows = [(1, "a b\tc\x0b\n d  e ", 5), (2, "f g", 6), (2, "f g", 6), (3, None, 7), (4, long, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumn("size", F.lit("x")).withColumn("group", F.lit(1))
    held = collections.defaultdict(list)
    for r in packing.pack(d, (4, 512)).collect():
        assert sum(r.sizes) == r.used and all(len(t.split(" ")) == n for t, n in zip(r.texts, r.sizes, strict=True))
        for i, start, t in zip(r.doc_ids, r.starts, r.texts, strict=True):
            held[i].append((start, t))
    assert " ".join(t for _, t in sorted(held[4])) == long
    assert held[1] == [(0, "a b c d e")] and held[2] == [(0, "f g")] * 2 and 3 not in held
    bare = packing.pack(d.where("doc_id < 4"), (4,), size=F.length("text")).collect()
    assert sum(r.used for r in bare) == sum(len(t or "") for _, t, _ in rows[:-1]) and all(t is None for r in bare for t in r.texts)


def plain_best_fit(sizes, opened, permitted):
    """Best fit by looking at every open bin for every piece."""
    room, used, where = [], [], []
    for k, n in enumerate(sizes):
        fits = [(r, b) for b, r in enumerate(room) if r >= n]
        if fits:
            # Among bins of equal room the last to get it.
            least = min(r for r, _ in fits)
            b = max((b for r, b in fits if r == least), key=lambda b: stamp[b])
        else:
            rest = sizes[k + 1 :]
            best = [c for c in opened if c >= n] or [min(c for c in permitted if c >= n)]
            fill = lambda c: n + min(c - n, sum(x for x in rest if x <= c - n))  # noqa: E731, B023
            c = min(best, key=lambda c: (packing.cost(c) / fill(c), c))
            b = len(room)
            room.append(c)
            used.append(0)
            stamp = stamp + [0] if b else [0]
        room[b] -= n
        used[b] += n
        stamp[b] = k + 1
        where.append(b)
    final = [min(c for c in permitted if c >= u) for u in used]
    return where, final


def test_best_fit_is_brute_force():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sizes = np.sort(rng.choice(np.arange(1, 65), 40, replace=False))[::-1].copy()
        for opened in ((64,), (16, 64), (8, 16, 32, 64)):
            where, final, total = packing.best_fit(sizes, opened, (8, 16, 32, 64))
            want = plain_best_fit(sizes.tolist(), opened, (8, 16, 32, 64))
            assert where.tolist() == want[0] and final == want[1] and total == sum(map(packing.cost, want[1]))


# --- preferences


def test_prompt_is_the_longest_common_prefix(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "x"), (0, 2, "user", "r"), (0, 3, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "x"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (1, 4, "user", None)]
    turns += [(2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, None, None), (7, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = preference.format_preferences(df, preference.pairs_by_id(df)).orderBy("pair_id", "part", "turn", "rank").collect()
    of = lambda pair, part: "".join(r.rendered for r in rows if r.pair_id == pair and r.part == part)
    assert of(0, "prompt") == "<|user|>\nq<|end|>\n<|assistant|>\nx<|end|>\n<|user|>\nr<|end|>\n"
    assert of(0, "chosen") == "<|assistant|>\ngood<|end|>\n" and of(0, "rejected") == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    trained = [r.rendered[r.train_from : r.train_to] for r in rows if r.train_to]
    assert trained == ["good<|end|>\n", "bad<|end|>\n"]
    assert of(1, "prompt") == "" and of(1, "chosen") and not of(1, "rejected")
    assert of(2, "prompt") and not of(2, "chosen") + of(2, "rejected")
    sides = {(r.pair_id, r.part) for r in rows if r.part != "prompt"}
    assert sides == {(p, s) for p in range(4) for s in ("chosen", "rejected")}
    assert {(r.pair_id, r.paired) for r in rows} == {(0, True), (1, False), (2, True), (3, True)}
    assert preference.format_preferences(df.limit(0), preference.pairs_by_id(df.limit(0))).count() == 0


# --- pipeline


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as p

    docs, sizes = spark.read.parquet(SF + "/documents.parquet"), []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        if name != p.STAGES[-1][0]:
            assert docs.columns == list(p.COLUMNS)
        rows = docs.collect()
        sizes.append(len(rows))
        if name == "exact dedup":
            assert len({r.text for r in rows}) == len(rows)
        if name == "n-gram Jaccard join":
            assert all(i == c for i, (_, c) in brute_components([(r.doc_id, r.text) for r in rows], 5, 80).items())
        if name == "mixing sources to target weights":
            words = sum(len(WORD.findall(r.text)) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert sum(r.used for r in rows) == words
    assert sizes[0] >= sizes[1] >= sizes[2]
