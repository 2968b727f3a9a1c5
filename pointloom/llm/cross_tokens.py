"""Alignment of two tokenizers' ids by a transducer over dangling suffixes.

Both tokenizers cut the same bytes, one space and the text. A transducer reads their tokens in turn: its
state is the side that leads and the bytes of it that the other side has not matched yet. The side that lags
gives the next token; where nothing is left over, a group of tokens closes. A transition depends on the state
and the token alone, so each is worked out once a worker and looked up from then on. Every transition but
a group's first pairs the token it reads with the one that leads, and these are the links: pairs of tokens
whose ranges of bytes overlap.

Scale: texts are encoded once, in Arrow batches; what is written is a narrow row per document with its
distinct pairs of ids and how often they are linked. Counts of the corpus come from those in one aggregation
that combines before its shuffle and go back to the documents by a join, broadcast up to a counted bound.
A task holds the tokens of one text at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import arrow_batches, materialize

TOKENIZERS = "/opt/tokenizers"
#: A pair is ``a * 2^20 + b``; vocabularies are below that.
_B_BITS = 20
#: Pairs of ids, of three numbers each, that are broadcast at most.
BROADCAST_PAIRS = 1_000_000
_ROWS = 256

#: How byte-level tokenizers part a text before they merge; a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encode = Callable[[str], list[int]]


def _byte_chars() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _in_merge_order(spec: dict, pieces: list[bytes], chars: dict[str, int]) -> bool:
    """Whether ids follow from merges alone, as ranks do: single bytes first, then what each merge makes."""
    if spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [bytes(chars[c] for c in a + b) for a, b in pairs]
    return sorted(pieces[:256]) == [bytes([b]) for b in range(256)] and pieces[256 : 256 + len(made)] == made


def byte_level(file: bytes) -> tuple[Encode, list[bytes]]:
    """A byte-level BPE from its JSON: encoder of one space and a text, bytes of each id.

    Where ids are ranks of merges, an encoder by ranks gives the same tokens in a quarter of the time.
    """
    spec = json.loads(file)
    chars, vocabulary = _byte_chars(), spec["model"]["vocab"]
    pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
    if _in_merge_order(spec, pieces, chars):
        from tiktoken import Encoding

        ranks = {p: i for i, p in enumerate(pieces[: 256 + len(spec["model"]["merges"])])}
        own = Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return lambda text: own.encode_ordinary(" " + text), pieces
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))  # strings of special tokens are plain text
    return lambda text: slow.encode(" " + text, add_special_tokens=False).ids, pieces


def piece_level(file: bytes) -> tuple[Encode, list[bytes]]:
    """A sentencepiece model that puts a space before a text itself: encoder, bytes of each id."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_proto=file)
    names = [own.id_to_piece(i) for i in range(own.vocab_size())]
    pieces = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return lambda text: own.encode(text), pieces


class Transducer:
    """States and transitions worked out so far; state 0 has no residual, the next token is A's there."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.pieces, self.ids = (a, b), {(0, b""): 0}
        self.states = [(0, b"")]
        self.steps: list[dict[int, int]] = [{}]
        self.a_leads = [False]
        self.closed: dict[int, str] = {}  # pairs of one token each that close a group, and the group

    def _state(self, lead: int, residual: bytes) -> int:
        key = (lead, residual) if residual else (0, b"")
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.a_leads.append(lead == 0)
        return self.ids[key]

    def step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that lags (A's in state 0)."""
        lead, residual = self.states[state]
        side = 1 - lead if residual else 0
        new = self.pieces[side][token]
        short = min(len(residual), len(new))
        if residual[:short] != new[:short]:
            raise ValueError("the tokens are of different bytes")
        to = self._state(lead, residual[short:]) if len(residual) > len(new) else self._state(side, new[short:])
        self.steps[state][token] = to
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """Closed groups as ``a1,a2|b1`` and the links as pairs, of two tokenizations of the same bytes."""
        groups, links, steps, a_leads, closed = [], [], self.steps, self.a_leads, self.closed
        i = j = 0
        while i < len(a):
            x = a[i]
            pair = x << _B_BITS | b[j]
            if pair in closed:  # both transitions are known
                groups.append(closed[pair])
                links.append(pair)
                i += 1
                j += 1
                continue
            i0, j0 = i, j
            state = steps[0].get(x) or self.step(0, x)
            i += 1
            while state:
                if a_leads[state]:
                    y = b[j]
                    j += 1
                else:
                    x = a[i]
                    i += 1
                links.append(x << _B_BITS | y)
                token = y if a_leads[state] else x
                to = steps[state].get(token)
                state = self.step(state, token) if to is None else to
            groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            if i - i0 == 1 and j - j0 == 1:
                closed[pair] = groups[-1]
        return groups, links


_loaded: dict[bytes, tuple[Encode, list[bytes], Encode, list[bytes], Transducer]] = {}


def _load(a_file: bytes, b_file: bytes):
    """Both tokenizers and their transducer, once a worker."""
    key = hashlib.sha256(a_file + b_file).digest()
    if key not in _loaded:
        (enc_a, a), (enc_b, b) = byte_level(a_file), piece_level(b_file)
        _loaded[key] = (enc_a, a, enc_b, b, Transducer(a, b))
    return _loaded[key]


def align_text(loaded, text: str | None) -> tuple[int, int, list[str], list[int]]:
    """Numbers of tokens, groups and links; nothing if the text is null, empty or not kept by a tokenizer."""
    enc_a, a_pieces, enc_b, b_pieces, transducer = loaded
    if not text:
        return 0, 0, [], []
    said = b" " + text.encode("utf-8", "surrogatepass")
    a = enc_a(text)
    if b"".join([a_pieces[i] for i in a]) != said:
        return 0, 0, [], []
    b = enc_b(text)
    if b"".join([b_pieces[i] for i in b]) != said:
        return 0, 0, [], []
    return len(a), len(b), *transducer.align(a, b)


_OWN = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))])
_OWN_DDL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<struct<pair: bigint, n: bigint>>"


def align_tokenizers(docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a_file`` is the JSON of a byte-level BPE, which encodes one space and the text, ``b_file`` a
    sentencepiece model, which encodes the text; both without special tokens, whose strings in a text are plain
    text. ``n_best`` counts links whose pair of ids is linked as often in the corpus as any of its B id,
    ``count_sum`` adds up how often the links' pairs are. ``groups_sha256`` is the hash of the groups
    ``a1,a2|b1;a3|b2,b3``; with ``keep_groups`` they are a column too. Null and empty texts, and those that
    a tokenizer changes (by normalising, or for want of a piece), have no tokens: zeros and ''. Repeated rows
    and ids give a row each and count in the corpus; other columns are not looked at. Empty input, no rows.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((a_file, b_file))  # two vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _load(*files.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part, rows, pairs, times, ends = batch.slice(at, _ROWS), [], [], [], [0]
                for text in part.column("_text"):
                    n_a, n_b, groups, links = align_text(loaded, text.as_py())
                    joined = ";".join(groups)
                    digest = hashlib.sha256(joined.encode()).hexdigest() if groups else ""
                    counts = Counter(links)
                    pairs += counts.keys()
                    times += counts.values()
                    ends.append(len(pairs))
                    rows.append((n_a, n_b, len(groups), len(links), digest, joined if keep_groups else None))
                cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OWN) if f.name != "pairs"]
                both = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], ["pair", "n"])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both))
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_id"), *cols], ["_row", "_id", *_OWN.names])

    slim = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    # Numbered, encoded and written in one job, so the numbers hold from here on.
    with arrow_batches(spark, _ROWS):
        each = materialize(slim.mapInArrow(run, f"_row bigint, _id {kind}, {_OWN_DDL}"), "token-links")
    own = each.select("_row", F.explode("pairs").alias("p")).select("_row", "p.*")
    totals = own.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)))  # A's vocabulary at most
    totals = materialize(totals.withColumn("best", (F.col("total") == F.max("total").over(of_b)).cast("long")), "pair-counts")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_PAIRS else totals
    sums = own.join(totals, "pair").groupBy("_row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = each.drop("pairs").join(sums, "_row", "left")
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if keep_groups else []))


def read_file(path: str) -> bytes:
    """A vocabulary from the machine of the driver."""
    with open(path, "rb") as f:
        return f.read()
