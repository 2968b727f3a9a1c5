"""Alignment of tokenizers against overlaps of byte ranges."""

import hashlib
import random
from collections import Counter

import pytest

from pointloom.llm.cross_tokens import TOKENIZERS, Transducer, align_tokenizers, byte_level, piece_level, read_file


@pytest.fixture(scope="module")
def files():
    return read_file(f"{TOKENIZERS}/byte_bpe_50k.json"), read_file(f"{TOKENIZERS}/piece_bpe_32k.model")


def ends(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(a, b, a_pieces, b_pieces):
    """Groups and links by comparing every range of A with those of B around it."""
    ra, rb = ends([a_pieces[i] for i in a]), ends([b_pieces[i] for i in b])
    links, start = [], 0
    for i, (s, e) in enumerate(ra):
        while rb[start][1] <= s:
            start += 1
        j = start
        while j < len(rb) and rb[j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups = []
    for lo, hi in zip([0, *cuts], cuts):
        own = [[str(x) for x, (s, e) in zip(ids, r) if lo <= s and e <= hi] for ids, r in ((a, ra), (b, rb))]
        groups.append("|".join(",".join(x) for x in own))
    return groups, links


def expected(docs, files):
    (ea, pa), (eb, pb) = byte_level(files[0]), piece_level(files[1])
    out, counts = [], Counter()
    for i, text in docs:
        a, b = (ea(text), eb(text)) if text else ([], [])
        said = (" " + (text or "")).encode()
        if not text or b"".join(pa[x] for x in a) != said or b"".join(pb[x] for x in b) != said:
            out.append((i, 0, 0, [], []))
            continue
        groups, links = plain(a, b, pa, pb)
        counts.update(links)
        out.append((i, len(a), len(b), groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted((i, na, nb, len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), digest(g)) for i, na, nb, g, k in out)


def test_against_ranges(spark, files):
    rng = random.Random(3)
    words = ["the", "Überraschung", "don't", "naïve", "日本語", "x" * 70, "<|endoftext|>", "<s>", "</s>", "<0x41>", "12,345", "\n\n", "  ", "\t", "émoji 🙂", "a▁b", " ", "ﬁ"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.choice([1, 5, 40])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " "), (203, "tie"), (203, "tie"), (204, "long words " * 500)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, pairs int").repartition(3)
    found = align_tokenizers(df, *files, keep_groups=True).collect()
    assert sorted(tuple(r)[:8] for r in found) == expected(docs, files)
    for r in found:
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_groups"] else "") == r["groups_sha256"]
    zeros = [r for r in found if r["n_a"] == 0]
    assert len(zeros) >= 2 and any(r["doc_id"] < 200 for r in zeros)  # a text with U+2581 comes back changed


def test_strings_of_special_tokens_are_text(files):
    ids = byte_level(files[0])[0]("<|endoftext|>")
    assert 50256 not in ids and len(ids) > 1
    assert not {0, 1, 2} & set(piece_level(files[1])[0]("<s> </s> <unk>"))


def test_an_encoder_by_ranks_gives_the_same_tokens(files):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(files[0].decode())
    own.encode_special_tokens = True
    rng = random.Random(9)
    parts = ["don't", " 12³", "\r\n\t ", "  ", "ｆｕｌｌ", "\u2028", "e\u0301", "𝔘", "<|endoftext|>", "'LL", "…", "a" * 900, "\x00"]
    encode = byte_level(files[0])[0]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert encode(text) == own.encode(" " + text, add_special_tokens=False).ids


def test_transitions_are_remembered():
    t = Transducer([b" ab", b"c", b"cd"], [b" a", b"bc", b"b", b"cd"])
    assert t.align([0, 1], [0, 1]) == (["0,1|0,1"], [0, 1, (1 << 20) | 1])
    before = len(t.states)
    assert t.align([0, 2], [0, 2, 3]) == (["0|0,2", "2|3"], [0, 2, (2 << 20) | 3])
    t.align([0, 1, 0, 2], [0, 1, 0, 2, 3])
    assert len(t.states) == before + 1
    with pytest.raises(ValueError):
        t.align([0], [3])


def test_empty_and_null_ids(spark, files):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *files).collect() == []
    assert [tuple(r)[:4] for r in align_tokenizers(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), *files).collect()] == [(None, 2, 2, 2)]
