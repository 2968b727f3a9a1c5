"""Quality rules: a learned decision list over text statistics.

Statistics of a text are DataFrame expressions. Sequential covering learns rules that reject: each is a
conjunction of thresholds, grown on two thirds of the labelled rows by information gain, pruned on the
other third, and kept while it is precise there; rows it covers leave, and the next rule is grown. The
list is emitted as one ordered ``CASE WHEN``.

Scale: one pass over the texts without a shuffle. What is learned from is a bounded number of labelled
rows (``MAX_LABELLED``), of which only the numbers reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import BLANKS, WORD, hashed_sample, let, text_or_empty

#: Labelled rows that rules are learned from at most, taken in order of a hash of the id.
MAX_LABELLED = 20_000
#: Fixed limits of the base test.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share", "same_next_share", "words_per_line")


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are in the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order."""

    def starts(s: Column) -> Column:  # s: (hash, place), sorted
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def covered(p: Column) -> Column:  # each window adds the words up to the next one's start
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    heavy = let(pairs, lambda s: let(starts(s), covered))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(heavy).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the counts of the base test and the ``FEATURES`` of the rules.

    Null text counts as empty: all counts are 0, shares too. Columns with the added names are replaced.
    """
    df = docs.withColumn("_text", text_or_empty(text_col))
    df = df.withColumn("_h", F.transform(F.array_remove(F.split("_text", BLANKS), ""), lambda w: F.xxhash64(w)))
    h, n = F.col("_h"), F.size("_h")
    window = lambda i: F.xxhash64(*(h[i + j] for j in range(WINDOW)))
    df = df.withColumn("_windows", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", F.transform(lines, lambda x: F.xxhash64(x)))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace("_text", BLANKS, "")).cast("long"),
            "n_symbols": _count(F.col("_text"), r"#*$%&|<>"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("_windows")),
            "_upper": _count(F.col("_text"), r"\p{Lu}"),
            "_bang": _count(F.col("_text"), "!"),
            "_distinct": F.size(F.array_distinct("_h")),
            "_same": F.size(F.filter("_h", lambda x, k: F.coalesce(F.get(h, k - 1) == x, F.lit(False)))),
            "_n_lines": F.size("_lines"),
        }
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "mean_chars": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("_upper", "word_chars"),
            "bang_share": share("_bang", "n_words"),
            "distinct_share": share("_distinct", "n_words"),
            "same_next_share": share("_same", "n_words"),
            "words_per_line": share("n_words", "_n_lines"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    return df.drop("_text", "_h", "_windows", "_lines", "_upper", "_bang", "_distinct", "_same", "_n_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else at most
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (x[self.feature] > self.threshold) if self.above else (x[self.feature] <= self.threshold)

    def column(self) -> Column:
        return (F.col(self.feature) > self.threshold) if self.above else (F.col(self.feature) <= self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 3, cuts: int = 64) -> list[Rule]:
    """Ordered rules that reject; ``bad`` marks the rows they should cover. No labels give no rules."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    grow, live, rules = ~prune, np.ones(n, bool), []
    # Thresholds lie midway between neighbouring quantiles, so that rows unlike any seen fall on the nearer side.
    middles = lambda v: (q := np.unique(np.quantile(v, np.linspace(0, 1, cuts))))[:-1] / 2 + q[1:] / 2
    tried = [Condition(f, up, float(t)) for f, v in x.items() if n for t in middles(v) for up in (True, False)]
    tried = [(c, c.holds(x)) for c in tried]
    while len(rules) < max_rules and (bad & live & grow).sum() >= min_covered:
        inside, rule = live & grow, []
        while len(rule) < max_conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, gain = None, 0.0
            for c, holds in tried:
                p, q = (inside & bad & holds).sum(), (inside & ~bad & holds).sum()
                if p >= min_covered and (g := p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0)))) > gain:
                    best, gain = (c, holds), g
            if best is None:
                break
            rule.append(best[0])
            inside = inside & best[1]
        worth = {}
        for k in range(1, len(rule) + 1):
            on = _covers(tuple(rule[:k]), x, n) & live & prune
            p, q = (on & bad).sum(), (on & ~bad).sum()
            worth[k] = (p - q) / (p + q) if p + q else -1.0
        if not worth:
            break
        k = max(worth, key=lambda k: (worth[k], -k))
        found = tuple(rule[:k])
        on = _covers(found, x, n) & live
        if (on & bad).sum() < min_covered or (on & bad).sum() < min_precision * on.sum() or worth[k] < 2 * min_precision - 1:
            break
        rules.append(found)
        live &= ~on
    return rules


def fit_rules(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the statistics of labelled rows (label 0 is bad); rows with a null label are left out.

    A document with several labels counts once, by the least of them; of several rows of an id the one with
    the least statistics counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = hashed_sample(known, max_labelled, id_col)
    own = statistics.select(id_col, F.struct(*FEATURES).alias("_s")).join(F.broadcast(chosen), id_col)  # max_labelled ids at most
    rows = own.groupBy(id_col).agg(F.min("_s").alias("_s"), F.first("_label").alias("_label")).select(id_col, "_s.*", "_label").collect()
    rows.sort(key=lambda r: (crc32(repr(r[id_col]).encode()), tuple(r)))
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn_rules(x, np.array([r["_label"] == 0 for r in rows], bool))


def decision_list(rules: list[Rule]) -> Column:
    """The rules as one ordered conditional: whether a row is kept."""
    out = None
    for rule in rules:
        on = F.lit(True)
        for c in rule:
            on = on & c.column()
        out = F.when(on, F.lit(False)) if out is None else out.when(on, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``kept``: false where the base test failed, else what the list says."""
    return statistics.withColumn("kept", ~F.col("base_failed") & decision_list(rules))
