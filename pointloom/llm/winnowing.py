"""Benchmark decontamination by winnowing: fingerprints meet in a join, hits are extended to exact windows.

Of every stretch of consecutive words as long as a window the least hash of its k-grams is a fingerprint (the
first of equal ones). A text and an item that share a window choose the same k-gram of it, so their
fingerprints meet: every shared span of a window or more is found. A fingerprint that meets is extended to
the windows around its place, which are compared by their words. Results are exact; hashes only propose.

An item of fewer words than a window is a window of its own length; each such length has fingerprints of
its own and a pass of its own.

Scale: texts are read once and never shuffled. Fingerprints of items are broadcast up to a counted bound;
beyond it they go in blocks of that size, each broadcast, over texts written once with their numbers. Hashing
and minima are plain expressions over a few words each, so they stay in generated code. What
meets is written as one narrow row per proposed window, with one row per document that numbers it in the
same job; only those rows are shuffled, by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.storage import BROADCAST_ROWS
from pointloom.llm.common import broadcast_if_small, materialize

#: Words are runs of digits, letters and anything beyond ASCII, after A-Z are lower-cased; this is what parts them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
_UPPER = "".join(map(chr, range(65, 91)))
#: A fingerprint is a hash above and its place in the text below.
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1
_HEAD = -1  # stands for the document itself among its fingerprints


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, BETWEEN), "")


def fingerprints(rows: DataFrame, window: int, gram: int = GRAM, heads: bool = False) -> DataFrame:
    """``rows`` once for each fingerprint ``_p`` of their words ``_w`` for windows of ``window`` words.

    Each step takes as many windows as a window has k-grams: running minima from both sides of its middle
    give them all, so a k-gram is hashed about twice and no array is built but the steps'. With ``heads``
    every row comes once more, as ``_HEAD``.
    """
    k = min(gram, window)
    each, n = window - k + 1, F.size("_w")
    steps = F.when(n >= window, F.sequence(F.lit(0), n - window, F.lit(each))).otherwise(F.array().cast("array<int>"))
    if heads:
        steps = F.concat(F.array(F.lit(_HEAD)), steps)
    df = rows.withColumn("_at", F.explode(steps))
    df = df.withColumns({f"_h{i}": F.xxhash64(F.get("_w", F.col("_at") + i)) for i in range(2 * each + k - 2)})
    place = lambda i: (F.col("_at") + i).cast("long")
    hashed = lambda i: F.xxhash64(*(f"_h{j}" for j in range(i, i + k)), F.lit(window))
    df = df.withColumns({f"_g{i}": hashed(i).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place(i)) for i in range(2 * each - 1)})
    least = lambda a, b: F.col(f"_g{a}") if a == b else F.least(*(f"_g{i}" for i in range(a, b + 1)))
    df = df.withColumns({f"_l{i}": least(i, each - 1) for i in range(each)} | {f"_r{i}": least(each, each + i) for i in range(each - 1)})
    df = df.withColumns({f"_m{i}": F.least(f"_l{i}", f"_r{i - 1}") if i else F.col("_l0") for i in range(each)})
    fits = lambda i: F.col("_at") + i <= n - window
    new = [F.when(fits(i) & (F.col(f"_m{i}") != F.col(f"_m{i - 1}")), F.col(f"_m{i}")) if i else F.col("_m0") for i in range(each)]
    new[0] = F.when(F.col("_at") == _HEAD, F.lit(_HEAD).cast("long")).otherwise(new[0])
    new[1:] = [F.when(F.col("_at") != _HEAD, c) for c in new[1:]]
    return df.select(*rows.columns, F.explode(F.array(*new)).alias("_p")).where("_p IS NOT NULL")


def _item_tables(items: DataFrame, window: int, gram: int) -> tuple[list[int], DataFrame, DataFrame]:
    """The lengths of windows; fingerprints ``(_fp, _t)``; windows ``(_window, items)``."""
    items = items.withColumn("_t", F.least(F.size("_w"), F.lit(window))).where("_t > 0")
    lengths = sorted(r[0] for r in items.select("_t").distinct().collect())  # at most as many as a window has words
    prints = [fingerprints(items.where(F.col("_t") == t).select("_w", "_t"), t, gram) for t in lengths or [window]]
    prints = reduce(DataFrame.union, prints).select(F.shiftright("_p", _PLACE_BITS).alias("_fp"), "_t").distinct()
    starts = F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("_t")))
    windows = items.select("_item", "_w", "_t", starts.alias("_s")).select("_item", F.array_join(F.slice("_w", F.col("_s") + 1, F.col("_t")), " ").alias("_window"))
    return lengths, prints, windows.groupBy("_window").agg(F.array_sort(F.collect_set("_item")).alias("items"))


def _proposed(rows: DataFrame, prints: DataFrame, window: int, gram: int, heads: bool) -> DataFrame:
    """``(_row, _id, n_words, start, end, _window)``: windows around fingerprints that meet, and a row per document."""
    own = fingerprints(rows, window, gram, heads)
    met = own.join(prints, F.shiftright("_p", _PLACE_BITS) == F.col("_fp"), "left").where(f"_fp IS NOT NULL OR _p = {_HEAD}")
    n, at = F.size("_w"), F.col("_p").bitwiseAND(F.lit(_PLACE)).cast("int")
    first, last = F.greatest(F.lit(0), at - (window - min(gram, window))), F.least(at, n - window)
    # Only the words around the place go on, not the text's.
    near = F.when(F.col("_p") != _HEAD, F.slice("_w", first + 1, last - first + window))
    met = met.select("_row", "_id", n.cast("long").alias("n_words"), first.alias("_first"), near.alias("_near"))
    part = lambda s: F.struct((F.col("_first") + s).alias("start"), (F.col("_first") + s + window).alias("end"), F.array_join(F.slice("_near", s + 1, F.lit(window)), " ").alias("_window"))
    none = F.array(F.lit(None).cast("struct<start: int, end: int, _window: string>"))
    around = F.when(F.col("_near").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.size("_near") - window), part))
    return met.select("_row", "_id", "n_words", F.explode(around).alias("_f")).select("_row", "_id", "n_words", "_f.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_hit``, ``spans``, ``items``, ``contaminated``.

    ``spans`` are the ranges of words (from 0, end exclusive) inside occurrences of windows, merged where they
    touch or overlap and in order; ``n_hit`` counts their words. ``items`` are the ids of items with a window
    that occurs, as strings, sorted, each once: items of one id are one item, and one without an id hits
    words but isn't listed. Null and empty texts have no words and no hits, such items no window. Repeated
    rows and ids of ``docs`` give a row each; its other columns are not looked at. Texts of any length are
    taken whole. Empty input gives no rows, an empty benchmark no hits.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), words_of(F.col(item_text_col)).alias("_w"))
    lengths, prints, windows = _item_tables(items, window, gram)
    prints = materialize(prints, "item-fingerprints")
    blocks = max(1, -(-prints.count() // block))
    passes = [(t, b) for t in lengths or [window] for b in range(blocks)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    # One pass reads and writes the numbers in one job; several read texts that are written with their numbers.
    rows = materialize(rows, "numbered-texts") if len(passes) > 1 else rows
    words = rows.select("_row", "_id", words_of(F.col("_text")).alias("_w"))
    some = lambda t, b: F.broadcast(prints.where((F.col("_t") == t) & (F.pmod("_fp", F.lit(blocks)) == b)).select("_fp"))  # noqa: E731  about ``block`` rows
    found = reduce(DataFrame.union, [_proposed(words, some(t, b), t, gram, heads=(t, b) == passes[0]) for t, b in passes])
    found = materialize(found, "proposed-windows")
    met = found.where("_window IS NOT NULL").join(broadcast_if_small(windows), "_window")
    rest = ["_row", "_id", "n_words"]
    both = met.select(*rest, "start", "end", "items").union(found.where("_window IS NULL").select(*rest, "start", "end", F.lit(None).cast("array<string>")))
    # Documents' own rows have no start, sort first and have a span of no words.
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    spans = both.withColumn("_opens", opens.cast("int"))
    spans = spans.withColumn("_span", F.sum("_opens").over(Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*rest, "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.collect_set("items")).alias("items"))
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    out = spans.groupBy(*rest).agg(
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))
