"""N-gram Jaccard self-join by parity sketches.

A document is the set of its word shingles. Each shingle flips one bit of the document's sketch, so the
Hamming distance of two sketches is at most the size of the sets' symmetric difference. For sizes a and b
a similarity of t percent allows a difference of (a + b)(100 - t) / (100 + t). A band's sketches have more
words than any two sizes of the band allow differences, so some word agrees between any two documents that
link, and documents meet in a join on (band, place, word). Documents near the lower end of the next band's
reach take part in that band too. Pairs that meet are verified on the shingles themselves.

Words are ``WORD_BITS`` wide and sparse: a word stands as the XOR of a hash of each bit that is set.
Of m words at least m - d agree where at most d bits differ. Words are ranked by the number of their set
bits, then by their key, which two documents do alike for a word that agrees; the best ranked that agrees is
then among the d + 1 best of either document, and only so many of its words are keys, d being the most
that the document's own size allows. So weak words, which say little, are left out.

Where a word of fewer than ``WEAK_BITS`` bits is still among them, the cycle lemma helps: of the words
that agree as many (m - d) are followed by one with at most one differing bit, that by words with at most
two in all, and so on around the sketch; the ranking holds among those starts. A weak word's key is
therefore lengthened by either half of the next word (one of them agrees), and if still weak by any third
of the one after (one of the three agrees). No link is lost by this. Set against each other are 64-bit hashes
of words and shingles, so all is exact up to a collision of those.

Links are found per group of documents, without emitting all pairs of a group: a group are those that
share a key with one centre, which is the least of all that have the key. First every centre is verified
against its group, which connects most of what belongs together. Groups that still hold several
components are compared in blocks: two blocks of documents meet in one task, which emits only pairs of
different components whose sketches are near enough, and these are verified: in one round a forest of
the nearest, which leaves few components apart that belong together, in the next all that still lie
between components. Every pair that could still join two components is so decided.

Scale: exact copies leave sketches once per task. Keys are aggregated before their shuffle, and only those
of two documents or more are joined, a join that Spark splits where one key is hot. Of pairs that
meet, sizes and the Hamming distance of short sketches (a bit per shingle) refuse most that don't link;
only the texts of documents in the pairs left are read again.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import components, discard, materialize
from pointloom.llm.words import mix, shingle_set

#: Bands of sizes grow by this factor, or by what the similarity needs if that is more.
BAND_GROWTH = 3.0
#: Bits of a word, as a power of two.
WORD_BITS = 20
#: Words beyond those that the tolerance asks for, so that short sets can leave empty ones out.
SPARE = 2
#: A key must come from so many set bits, or it is lengthened.
WEAK_BITS = 2
#: Copies that a task remembers, so as to emit their sketch once.
SEEN = 100_000
#: Members of a group that are compared with each other, or with so many others, in one task.
BLOCK = 512
#: Ids of documents that met another are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000


def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """Bands [lo, hi) of set sizes up to ``largest``; smaller sets link to equal sets only."""
    lo = max(1, -(-percent // (100 - percent))) if percent < 100 else largest + 1
    out, growth = [], max(BAND_GROWTH, 105 / percent)
    while lo <= largest:
        hi = max(lo + 2, int(lo * growth))
        out.append((lo, hi))
        lo = hi
    return out


def short_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of about a bit per shingle; a power of two, so that a longer one folds to it."""
    bits = 64 << max(0, (len(shingles) - 1).bit_length() - 6)
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def tolerance(a: int, b: int, percent: int) -> int:
    """The most that the sets of a pair of these sizes differ by if they link."""
    return (a + b) * (100 - percent) // (100 + percent)


def odd_bits(shingles: np.ndarray, words: int) -> np.ndarray:
    """The set bits of the parity sketch, ascending: word times 2**WORD_BITS plus the bit in it."""
    bits = (shingles >> np.uint64(32)) * np.uint64(words) >> np.uint64(32 - WORD_BITS)
    if (bits[1:] == bits[:-1]).any():  # shingles are sorted, so those of one bit are neighbours
        bits, times = np.unique(bits, return_counts=True)
        bits = bits[times % 2 == 1]
    return bits


def band_keys(shingles: np.ndarray, band: int, hi: int, percent: int) -> np.ndarray:
    """The keys under which a set, given as sorted hashes, meets others in the band of sizes below ``hi``."""
    n, one = len(shingles), np.uint64(WORD_BITS)
    words = tolerance(hi - 1, hi - 1, percent) + 1 + SPARE
    keep = min(words, tolerance(n, min(hi - 1, 100 * n // percent), percent) + 1)
    bits = odd_bits(shingles, words)
    xors = np.zeros(len(bits) + 1, np.uint64)
    np.bitwise_xor.accumulate(mix(bits), out=xors[1:])
    place = np.arange(words + 1, dtype=np.uint64)
    edge = np.searchsorted(bits, place << one)
    count, word = np.diff(edge), xors[edge[1:]] ^ xors[edge[:-1]]
    key = mix(mix(word + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)) + place[:-1])
    rank = np.minimum(count, 255).astype(np.uint64) << np.uint64(56) | key >> np.uint64(8)
    best = np.argsort(rank, kind="stable")[words - keep :]
    weak = count[best] < WEAK_BITS
    out, at = [key[best[~weak]]], best[weak]
    if not len(at):
        return out[0]

    def part(of: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """XOR and number of the set bits in the k-th part of these words."""
        start = (of % words).astype(np.uint64) << one
        a, b = (np.searchsorted(bits, start + np.uint64((1 << WORD_BITS) * i // parts)) for i in (k, k + 1))
        return xors[b] ^ xors[a], b - a

    for h in (0, 1):
        half, more = part(at + 1, h, 2)
        longer = mix(mix(key[at] + np.uint64(2 * h + 1)) + half)
        still = count[at] + more < WEAK_BITS
        out.append(longer[~still])
        for t in (0, 1, 2):
            third, _ = part(at[still] + 2, t, 3)
            out.append(mix(mix(longer[still] + np.uint64(2 * t + 7)) + third))
    return np.concatenate(out)


def _keys_of(shingles: np.ndarray, percent: int, known: list[tuple[int, int]]) -> np.ndarray:
    n, out = len(shingles), []
    for b, (lo, hi) in enumerate(known):
        if lo <= n < hi or (n < lo and percent * lo <= 100 * n):
            out.append(band_keys(shingles, b, hi, percent))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sketches(k: int, percent: int):
    def run(batches):
        seen: OrderedDict[tuple, None] = OrderedDict()
        known: list[tuple[int, int]] = []
        for batch in batches:
            sizes, first, second, keys, short = [], [], [], [], []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingle_set(text, k)
                n = len(s)
                a, b = (int(mix(s ^ np.uint64(c)).sum()) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                sizes.append(n)
                first.append(a - (1 << 63))
                second.append(b - (1 << 63))
                if id_ is None or (n, a, b) in seen:  # rows with a null id don't stand for their copies
                    if id_ is not None:
                        seen.move_to_end((n, a, b))
                    keys.append(np.zeros(0, np.uint64))
                    short.append(None)
                    continue
                seen[n, a, b] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                if not known or known[-1][1] <= n:
                    known = bands(percent, max(2 * n, 1 << 16))
                keys.append(_keys_of(s, percent, known))
                short.append(short_sketch(s) if n else None)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(short, pa.binary()), lists], ["id", "n_shingles", "d1", "d2", "short", "keys"]
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Short sketches of one length as rows, folded to so many 64-bit words."""
    x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Hamming distances of pairs of short sketches, the longer one folded to the other's length."""
    width = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(left), np.int64)
    for x, y in np.unique(width, axis=0).tolist():  # few: lengths are powers of two
        on = np.flatnonzero((width == (x, y)).all(1))
        a, b = (_folded([k[i] for i in on], min(x, y)) for k in (left, right))
        out[on] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def hamming(a: bytes, b: bytes) -> int:
    return int(distances([a], [b])[0])


def _possible(percent: int):
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            d = distances(batch.column("ka").to_pylist(), batch.column("kb").to_pylist())
            ok = d * (100 + percent) <= (na + nb) * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _within_distance(pairs: DataFrame, each: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda x: each.where("short is not null").select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("short").alias(f"k{x}"))
    near = (percent * F.col("na") <= 100 * F.col("nb")) & (percent * F.col("nb") <= 100 * F.col("na"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b", "na", "nb", "ka", "kb")
    return both.mapInArrow(_possible(percent), "a bigint, b bigint")


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(pairs: DataFrame, each: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: by size and sketch first, then on the shingles of those left."""
    pairs = materialize(_within_distance(pairs, each, percent).distinct(), "possible")
    met = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "met")
    chosen = texts.join(F.broadcast(met) if met.count() <= BROADCAST_IDS else met, "id", "left_semi")
    sets = materialize(chosen.mapInArrow(_sets(k), "id bigint, set binary"), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    links = materialize(both.mapInArrow(_verified(percent), "a bigint, b bigint"), "links")
    discard(pairs, met, sets)
    return links


def _forest(pairs: list[tuple[int, int, int]], comp: np.ndarray) -> list[tuple[int, int, int]]:
    """Of (distance, i, j) the nearest that connect all components which the pairs connect."""
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for d, i, j in sorted(pairs):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((d, i, j))
    return out


def _near_in_block(rows: list[tuple], percent: int, across: bool, forest: bool) -> tuple[list[int], list[int]]:
    """Ids (a, b) of different components whose sizes and sketches allow a link, of a block or two.

    ``rows``: block, id, comp, size, sketch, by block. Sketches are folded to the shortest. With
    ``forest`` only the nearest pairs that connect as many components as all would.
    """
    ids, comp, n = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
    width = min(len(r[4]) for r in rows) // 8
    x = np.empty((len(rows), width), np.uint64)
    for i, r in enumerate(rows):
        x[i] = _folded([r[4]], width)[0]
    cut = next((i for i, r in enumerate(rows) if r[0] != rows[0][0]), len(rows)) if across else len(rows)
    start, step = (cut if across else 0), max(1, 2_000_000 // max(1, len(rows) * width))
    found: list[tuple[int, int, int]] = []
    for at in range(0, cut, step):
        left = slice(at, min(cut, at + step))
        d = np.bitwise_count(x[left, None] ^ x[None, start:]).sum(-1, dtype=np.int64)
        na, nb = n[left, None], n[None, start:]
        ok = (d * (100 + percent) <= (na + nb) * (100 - percent)) & (percent * na <= 100 * nb) & (percent * nb <= 100 * na) & (comp[left, None] != comp[None, start:])
        if not across:
            ok &= np.arange(left.start, left.stop)[:, None] < np.arange(len(rows))[None]
        i, j = np.nonzero(ok)
        found.extend(zip(d[i, j].tolist(), (i + left.start).tolist(), (j + start).tolist(), strict=True))
    found = _forest(found, comp) if forest else found
    return [int(ids[i]) for _, i, _ in found], [int(ids[j]) for _, _, j in found]


def _compared(percent: int, forest: bool):
    names = ("group", "i", "j", "block", "id", "comp", "n", "short")

    def run(batches):
        key, rows = None, []

        def done():
            if len({r[2] for r in rows}) > 1 and (key[1] == key[2] or len({r[0] for r in rows}) > 1):
                a, b = _near_in_block(rows, percent, key[1] != key[2], forest)
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            return None

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if r[:3] != key:
                    if key is not None and (found := done()) is not None:
                        yield found
                    key, rows = r[:3], []
                rows.append(r[3:])
        if key is not None and (found := done()) is not None:
            yield found

    return run


def _labels(texts: DataFrame, each: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Components (node, comp) of all links; ``members``: group (its centre's id) and id, the centre apart."""
    links = _verify(members.select(F.col("group").alias("a"), F.col("id").alias("b")), each, texts, k, percent)
    labels = materialize(components(links), "labels")
    own = each.where("short is not null").select("id", F.col("n_shingles").alias("n"), "short")
    # First the pairs that would connect most if they link; then all that lie between components still.
    for forest in (True, False):
        left = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        open_ = left.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        # Written first, so that the join beside it stands alone and can be split where a group is large.
        open_ = materialize(open_.select("group", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open-groups")
        left = materialize(left.join(open_, "group").join(own, "id"), "open-members")
        if left.limit(1).count() == 0:
            return labels
        block = F.pmod(F.hash("id"), F.col("blocks"))
        dealt = left.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n", "short")
        near = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "block", "id").mapInArrow(_compared(percent, forest), "a bigint, b bigint")
        more = _verify(near.distinct(), each, texts, k, percent)
        discard(open_, left)
        if more.limit(1).count():
            links = links.union(more)
            labels = materialize(components(links), "labels")
    return labels


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id``.

    Rows link when 100 * intersection >= percent * union of their shingle sets; ``component_id`` is the
    smallest id reachable by links, the row's own included. Rows without words link with nothing and
    rows with a null id take part in no link; such a component is the row's own id. Rows of one id count
    as one document. Ids are integers. Other columns of ``docs`` are not needed; empty input gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    each = materialize(texts.mapInArrow(_sketches(k, percent), "id bigint, n_shingles bigint, d1 bigint, d2 bigint, short binary, keys array<bigint>"), "sketches")
    keys = each.where("id is not null").select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last")
    shared = materialize(shared, "shared-keys")
    groups = keys.join(shared, "key").where("id <> centre")
    # Groups of one centre become one, so that documents which share many keys are compared once.
    members = groups.select(F.col("centre").alias("group"), "id").distinct()
    members = materialize(members, "members")
    slim = materialize(each.drop("keys"), "documents")
    discard(each, shared)  # the keys are the bulk, and nothing reads them any more
    labels = _labels(texts, slim, members, k, percent)
    slim = slim.drop("short")
    same = ["n_shingles", "d1", "d2"]
    found = slim.join(labels, slim["id"] == labels["node"], "left")
    # Copies share the label of the one whose sketch took part; a label's component is its least id.
    linked = found.where("n_shingles > 0 AND id is not null")
    copies = linked.groupBy(*same).agg(F.min("comp").alias("comp"), F.min("id").alias("least"))
    copies = materialize(copies.withColumn("label", F.coalesce("comp", "least")), "copies")
    least = copies.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(copies.join(least, "label").select(*same, F.col("component_id").alias("named")), "components")
    out = slim.join(named, same, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("named")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
