"""Variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length, and pieces are packed, longest first,
each into the fullest bin that still takes it. Where none does, the permitted length that costs least per
token the bin can be expected to hold is opened, judged by the pieces that are still to come. At the end
each bin is downsized to the shortest permitted length that holds its contents.

The permitted lengths are chosen jointly: each group is packed once for every choice of the lengths
that bins may open with (each non-empty subset: 15 for four lengths), and the cheapest result after
downsizing is taken. As each group takes its own best choice, all together cost no more than under any
one choice for all.

Scale: texts cross the network once, as pieces. Pieces are dealt by a hash of row and offset into groups of
about ``GROUP_PIECES`` or ``GROUP_BYTES``, which are packed independently, so that a group is one bounded
task and what is lost at its edges is a bin or so. The number of groups follows the data.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import WORD, text_or_empty

LENGTHS = (512, 1024, 2048, 4096)
GROUP_PIECES = 5_000
GROUP_BYTES = 16 << 20
#: Tasks at most; beyond, a task takes groups one after the other.
MAX_TASKS = 100_000
#: Cost of a sequence of n tokens: n for the linear layers, and n * n / QUADRATIC for attention.
QUADRATIC = 16_384


def cost(length: int) -> float:
    return length + length * length / QUADRATIC


def best_fit(sizes: np.ndarray, opened: tuple[int, ...], permitted: tuple[int, ...]) -> tuple[np.ndarray, list[int], float]:
    """Bin of each piece (given longest first), each bin's downsized length, the total cost."""
    counts = np.bincount(sizes, minlength=max(permitted) + 1)
    prefix = None
    rooms: list[int] = []  # the rooms that open bins have, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    where = np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        counts[n] -= 1
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            fits = [c for c in opened if c >= n] or [min(c for c in permitted if c >= n)]
            if len(fits) == 1:
                room = fits[0]
            else:
                if prefix is None or prefix[0] != n:  # once per length is near enough
                    k = np.arange(len(counts))
                    prefix = (n, np.cumsum(k * counts))
                fill = lambda c: n + min(c - n, float(prefix[1][c - n]))  # noqa: E731, B023
                room = min(fits, key=lambda c: (cost(c) / fill(c), c))
            b = len(used)
            used.append(0)
        where[i] = b
        used[b] += n
        if room > n:
            if room - n not in by_room:
                insort(rooms, room - n)
                by_room[room - n] = []
            by_room[room - n].append(b)
    final = [min(c for c in permitted if c >= u) for u in used]
    return where, final, sum(map(cost, final))


def pack_group(sizes: np.ndarray, permitted: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order, bin of each piece in that order, and length of each bin: the cheapest over opening choices."""
    order = np.argsort(-sizes, kind="stable")
    choices = [c for n in range(1, len(permitted) + 1) for c in combinations(permitted, n)]
    tried = [best_fit(sizes[order], tuple(sorted(c)), permitted) for c in choices]
    where, final, _ = min(tried, key=lambda t: t[2])
    return order, where, final


def _cut(top: int):
    """Each row's words as pieces of at most ``top``, in one pass over its text."""
    word = re.compile(WORD)

    def run(batches):
        for batch in batches:
            of, starts, sizes, texts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = word.findall(text or "")
                for at in range(0, len(words), top):
                    piece = words[at : at + top]
                    of.append(i)
                    starts.append(at)
                    sizes.append(len(piece))
                    texts.append(" ".join(piece))
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("row").take(of), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "row", "start", "size", "text"])

    return run


def _lists(offsets: np.ndarray, values: pa.ChunkedArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.combine_chunks())


def pack(docs: DataFrame, permitted: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, group_pieces: int = GROUP_PIECES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per bin: ``bin_id``, ``capacity``, ``used``, ``doc_ids``, ``starts``, ``sizes``, ``texts``.

    The four arrays describe the pieces in the bin: the document, the piece's first token in it, its
    tokens, and its words joined by single blanks. Tokens are words unless ``size``, their number, is given;
    then ``texts`` are null. Documents without tokens (null or empty texts) are in no bin. Repeated rows
    are packed as often as they occur; null ids are kept. Equal sizes go by id, then start, then the row's
    place. Empty input gives no rows; other columns are not needed, whatever their names.
    """
    permitted = tuple(sorted(set(permitted)))
    top = permitted[-1]
    kind = dict(docs.dtypes)[id_col]
    row = F.monotonically_increasing_id().alias("row")
    if size is None:
        text = text_or_empty(text_col)
        whole = docs.select(F.col(id_col).alias("doc_id"), row, text.alias("text"))
        pieces = whole.mapInArrow(_cut(top), f"doc_id {kind}, row bigint, start bigint, size bigint, text string")
        # A piece has a whole document or the words of some bytes, so both bound a group's pieces.
        total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    else:
        sized = docs.select(F.col(id_col).alias("doc_id"), row, size.cast("long").alias("n")).where("n > 0")
        pieces = sized.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))))
        pieces = pieces.select("doc_id", "row", "start", F.least(F.col("n") - F.col("start"), F.lit(top)).alias("size"), F.lit(None).cast("string").alias("text"))
        total = sized.agg(F.sum(F.ceil(F.col("n") / top)), F.lit(0)).first()
    groups = max(1, -(-int(total[0] or 0) // group_pieces), -(-int(total[1] or 0) // group_bytes))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        order, where, final = pack_group(table.column("size").to_numpy(), permitted)
        table, where = table.take(pa.array(order[np.argsort(where, kind="stable")])), np.sort(where)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(final)))))
        used = np.add.reduceat(table.column("size").to_numpy(), offsets[:-1])
        ids = table.column("group")[0].as_py() * 2**32 + np.arange(len(final))
        lists = [_lists(offsets, table.column(c)) for c in ("doc_id", "start", "size", "text")]
        return pa.table([pa.array(ids, pa.int64()), pa.array(final, pa.int32()), pa.array(used, pa.int64()), *lists], ["bin_id", "capacity", "used", "doc_ids", "starts", "sizes", "texts"])

    schema = f"bin_id bigint, capacity int, used bigint, doc_ids array<{kind}>, starts array<bigint>, sizes array<bigint>, texts array<string>"
    # As many partitions as groups, else small ones would be put together in few tasks.
    return dealt.repartition(min(groups, MAX_TASKS), "group").groupBy("group").applyInArrow(run, schema)
