"""Winnowing against every window of every text."""

import random
import re

import pytest

from pointloom.llm.winnowing import decontaminate

SCHEMA, ITEMS = "doc_id long, text string, start int", "item_id long, text string"


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text, _ in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, said in items:
            v = plain_words(said)
            t = min(10, len(v))
            windows = {tuple(v[i : i + t]) for i in range(len(v) - t + 1)} if t else set()
            at = [i for i in range(len(w) - t + 1) if tuple(w[i : i + t]) in windows]
            hit |= {p for i in at for p in range(i, i + t)}
            if at and item is not None:
                found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    found = df.collect()
    for r in found:
        assert r["n_hit"] == sum(e - s for s, e in r["spans"])
        assert all(a[1] < b[0] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r[0], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "ÉTÉ", "don't", "x"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, say(rng.choice([10, 11, 14, 40]))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "..."), (103, "Alone"), (104, "w1 w2 w3"), (104, say(20)), (None, say(15)), (105, items[0][1]), (106, "a " * 60)]
    docs = []
    for i in range(60):
        parts = [say(rng.choice([0, 3, 30]))]
        for _ in range(rng.choice([0, 1, 3])):
            v = plain_words(rng.choice(items)[1])
            a = rng.randrange(len(v)) if v else 0
            parts += [" ".join(v[a : a + rng.choice([9, 10, 12, 50])]).upper().replace(" ", "\t!"), say(rng.choice([0, 1, 5]))]
        docs.append((i, " ".join(parts), i))
    docs += [(7, "a " * 500, 0), (7, "a " * 500, 0), (None, None, 0), (61, "", 0), (62, "alone", 0), (None, items[3][1], 0)]
    docs += [(63, " ".join([say(20000), items[2][1], say(20000)]), 0)]
    return docs, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_every_window_is_found(spark, corpus, block):
    docs, items = corpus
    found = decontaminate(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(items, ITEMS), block=block)
    assert rows(found) == brute(docs, items)


def test_long_items_alone_take_one_pass(spark, corpus):
    docs, items = corpus
    items = [x for x in items if len(plain_words(x[1])) >= 10]
    found = decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert rows(found) == brute(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    no_docs, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert rows(decontaminate(no_docs, spark.createDataFrame(items, ITEMS))) == []
    assert rows(decontaminate(spark.createDataFrame(docs, SCHEMA), no_items)) == brute(docs, [])
