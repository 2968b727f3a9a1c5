"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a private-key block, a run of at least 16 credential characters or the value, of at least 8
characters, of a credential-like assignment; none has an upper length, and whether a run without digits is a
secret is for the forest to say. An assigned value ends at a blank or quote. Features are its length,
character classes and their transitions, how well its letters follow each other as in the corpus and how
much of it the corpus's own words cover, the path it lies in and the words beside it. A forest of decision
trees, trained in numpy from labelled findings, says whether it is a secret.

Dictionary and letter transitions are learned from the documents: words are counted over the whole corpus,
the ``DICTIONARY_WORDS`` most frequent ones are the dictionary, and transitions are counted on those.

Scale: one pass counts words, combined within each batch before the only shuffle; one pass scans. Tasks
need the dictionary and the trees, a bounded number of words and numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_-])")
ASSIGNED = re.compile(r"(?i)\b(?:pass(?:word|wd)?|pwd|secret)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,}+)")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END [A-Z0-9 ]{0,40}-----")
BLOCK_BODY = re.compile(r"(?:\s*+(?:[A-Za-z0-9+/=]{16,}+|[A-Za-z-]{1,40}: [^\n]*+|[A-Za-z0-9+/]{1,15}={1,2}))*+")
CLOSING = ".,;:)]}>"
CUES = frozenset("token key secret password passwd pwd api apikey auth bearer credential credentials access private".split())
AGAINST = frozenset("sha sha1 sha256 md5 commit checksum digest hash uuid guid revision etag example sample dummy id version build".split())
TEST_PATHS = re.compile(r"(?i)test|example|sample|fixture|mock|doc")
_NEAR = 48
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_LETTERS = re.compile(r"[a-z]{3,}")
_WORDS = re.compile(r"[a-z]{3,20}")
#: The dictionary's words at most, and how often each must occur: a secret that is said once is no word.
DICTIONARY_WORDS, LEAST_COUNT = 5_000, 5
FEATURES = ("length", "digits", "upper", "lower", "other", "transitions", "entropy", "hex", "dictionary", "language", "vowels", "longest_word", "cue", "against", "assigned", "quoted", "uuid", "block", "repeats", "test_path")


@dataclass(frozen=True)
class Language:
    """The corpus's words, and how likely a letter follows another in them (log2; row and column 26 the word's edge)."""

    words: frozenset[str] = frozenset()
    follows: np.ndarray = field(default_factory=lambda: np.full((27, 27), np.log2(1 / 27)))

    @staticmethod
    def of(counts: dict[str, int]) -> Language:
        seen = np.ones((27, 27))
        for word, n in counts.items():
            codes = [26, *(ord(c) - 97 for c in word), 26]
            np.add.at(seen, (codes[:-1], codes[1:]), np.log1p(n))
        return Language(frozenset(counts), np.log2(seen / seen.sum(1, keepdims=True)))

    def fit(self, letters: str) -> float:
        """Mean log2 likelihood of the transitions in a run of letters."""
        codes = np.frombuffer(letters.encode(), np.uint8).astype(np.int64) - 97
        return float(self.follows[codes[:-1], codes[1:]].mean())

    def covered(self, letters: str) -> tuple[int, int]:
        """Letters that words cover, taken from the left, longest first; the longest word."""
        at, total, longest = 0, 0, 0
        while at < len(letters):
            n = next((n for n in range(min(20, len(letters) - at), 2, -1) if letters[at : at + n] in self.words), 0)
            total, longest, at = total + n, max(longest, n), at + (n or 1)
        return total, longest


def learn_language(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> Language:
    """Words of 3 to 20 letters a-z that occur ``LEAST_COUNT`` times, counted over all texts; ties go by the word.

    Empty input gives no words.
    """

    def run(batches):
        for batch in batches:
            counts = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(_WORDS.findall((text or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return Language.of({r["word"]: r["n"] for r in counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(most).collect()})


def features(text: str, a: int, b: int, path: str = "", language: Language | None = None) -> list[float]:
    """The candidate text[a:b] as numbers, named by ``FEATURES``."""
    language = language or Language()
    s = text[a:b]
    n = len(s)
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    digit, upper, lower = (codes >= 48) & (codes <= 57), (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)
    kinds = digit * 1 + upper * 2 + lower * 3
    counts = np.unique(codes, return_counts=True)[1] / n
    runs = _LETTERS.findall(s.lower())
    covered = [language.covered(r) for r in runs]
    letters = sum(len(r) for r in runs)
    near = re.findall(r"[a-z0-9]+", text[max(0, a - _NEAR) : a].lower())[-4:] + re.findall(r"[a-z0-9]+", text[b : b + _NEAR // 2].lower())[:1]
    before = text[max(0, a - 4) : a]
    return [
        min(n, 200),
        *(float(k.mean()) for k in (digit, upper, lower)),
        float((kinds == 0).mean()),
        float((kinds[1:] != kinds[:-1]).sum() / n),
        float(-(counts * np.log2(counts)).sum()),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        sum(c for c, _ in covered) / n,
        sum(language.fit(r) * len(r) for r in runs) / letters if letters else -10.0,
        float(np.isin(codes | 32, [97, 101, 105, 111, 117]).mean()),
        max((w for _, w in covered), default=0) / n,
        float(bool(CUES & set(near))),
        float(bool(AGAINST & set(near))),
        float("=" in before or ":" in before),
        float(before[-1:] in "\"'" and before != ""),
        float(bool(_UUID.fullmatch(s))),
        float(s.startswith("-----BEGIN")),
        float((codes[1:] == codes[:-1]).sum() / n),
        float(bool(TEST_PATHS.search(path or ""))),
    ]


def labelled_findings(n: int = 3000, seed: int = 11, language: Language | None = None) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings (text, start, end, path, label) drawn from rules, for want of a labelled table.

    Real: random keys in the usual formats, random and made-up passwords, key blocks, mostly after a credential
    cue. False: digests and revisions, UUIDs, placeholders, identifiers, paths and long words, some of them
    after a credential cue too. Words beside them and in them are the language's.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    common = sorted(language.words) if language and language.words else "the and value name user data file path index page image main class function return string number release license order".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    word = lambda: pick(common)
    words = lambda k: [word() for _ in range(k)]
    big, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    small, b62 = big.lower(), big + big.lower() + "0123456789"
    out = []
    for i in range(n):
        real, cue = int(i % 2 == 0), ""
        if real:
            kind = int(rng.integers(12))
            value = [
                lambda: chars(hexa, pick([32, 40, 64])),
                lambda: chars(b62 + "+/_-", int(rng.integers(20, 90))),
                lambda: "AKIA" + chars(big + "234567", 16),
                lambda: pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-"]) + chars(b62, int(rng.integers(16, 40))),
                lambda: "eyJ" + chars(b62, 30) + "_" + chars(b62 + "_-", int(rng.integers(40, 200))),
                lambda: chars(big + small, int(rng.integers(16, 64))),
                lambda: chars(b62, 39) + "=",
                lambda: chars(b62 + "!$%&?#*", int(rng.integers(8, 20))),
                lambda: word().capitalize() + chars("0123456789", 4) + pick("!$%#") + word(),
                lambda: chars(b62 + "+/", int(rng.integers(90, 700))),
                lambda: "-----BEGIN " + pick(["", "RSA ", "EC "]) + "PRIVATE KEY-----\n" + "\n".join(chars(b62 + "+/", 64) for _ in range(int(rng.integers(3, 20)))) + "\n-----END PRIVATE KEY-----",
                lambda: chars(b62, int(rng.integers(16, 44))),
            ][kind]()
            short = kind in (7, 8)
            cue = pick(["password", "pwd", "secret", "passwd"]) if short else pick(sorted(CUES)) if rng.random() < 0.85 else word()
            before = pick([f'{cue} = "', f"{cue}: ", f"{cue}='", f"{cue}=", f"{cue} is " if not short else f"{cue}="]) if kind != 10 else ""
        else:
            kind = int(rng.integers(10))
            h = chars(hexa, 32)
            value = [
                lambda: chars(hexa, pick([32, 40, 64])),
                lambda: f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}",
                lambda: pick("_-").join(words(int(rng.integers(3, 6)))) + pick(["", "1", "22"]),
                lambda: "/".join(words(int(rng.integers(3, 7)))) + pick(["", "2", "/index"]),
                lambda: "your-" + word() + "-" + pick(["token", "password", "secret", "here"]),
                lambda: "".join(w.capitalize() for w in words(int(rng.integers(3, 6)))),
                lambda: pick("xX0*-=_A") * int(rng.integers(16, 60)),
                lambda: "".join(words(int(rng.integers(2, 5)))),
                lambda: "-".join([word(), chars("0123456789", 4), chars("0123456789", 2), chars("0123456789", 2), word()]),
                lambda: "".join(chars("0123456789", int(rng.integers(16, 30)))),
            ][kind]()
            value = value if len(value) >= 16 else value + "-" + "_".join(words(4))
            cue = pick(sorted(AGAINST)) if kind < 2 or rng.random() < 0.5 else pick(sorted(CUES)) if rng.random() < 0.4 else word()
            before = pick([f"{cue} ", f"{cue}: ", f"{cue} = ", f'{cue}: "', "see ", "in ", ""])
        if kind != 10 and rng.random() < 0.2:
            value, before = value.upper() if rng.random() < 0.5 else value, before.upper()
        left = " ".join(words(3)) + " "
        text = left + before + value + pick(['" ', " ", "\n"]) + word()
        path = pick(["", "src/app.py", "conf/prod.yml"]) if real or rng.random() < 0.6 else pick(["tests/data.py", "docs/example.md"])
        out.append((text, len(left + before), len(left + before + value), path, real))
    return out


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, share of label 1), the root first."""
    nodes: list = []

    def grow(rows: np.ndarray, level: int) -> int:
        at, own = len(nodes), y[rows]
        nodes.append((-1, 0.0, 0, 0, float(own.mean())))
        if level == depth or len(rows) < 8 or own.min() == own.max():
            return at
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)]:
            v = x[rows, f]
            for t in np.unique(np.quantile(v, rng.random(8))):
                on = v <= t
                k = int(on.sum())
                if 0 < k < len(rows):
                    p, q = own[on].mean(), own[~on].mean()
                    gini = k * p * (1 - p) + (len(rows) - k) * q * (1 - q)
                    if best is None or gini < best[0]:
                        best = (gini, int(f), float(t), on)
        if best is None:
            return at
        left, right = grow(rows[best[3]], level + 1), grow(rows[~best[3]], level + 1)
        nodes[at] = (best[1], best[2], left, right, float(own.mean()))
        return at

    grow(np.arange(len(y)), 0)
    return nodes


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 3) -> list[np.ndarray]:
    """Trees grown on bootstrap samples, each split choosing among a few random features."""
    out = []
    for i in range(trees):
        rng = np.random.Generator(np.random.PCG64([seed, i]))
        rows = rng.integers(0, len(y), len(y))
        out.append(np.array(_tree(x[rows], y[rows].astype(float), rng, depth), float))
    return out


def forest_scores(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of label 1 over the trees."""
    total, every = np.zeros(len(x)), np.arange(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := t[at, 0] >= 0).any():
            f = t[at, 0].astype(np.int64)
            goes = np.where(x[every, np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
            at = np.where(inner, goes, at)
        total += t[at, 4]
    return total / max(1, len(forest))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private-key blocks: to the line that ends one, or over what can be its body where another begins first."""
    if "PRIVATE KEY" not in text:
        return []
    begins, stops = list(KEY_BLOCK.finditer(text)), [m.span() for m in BLOCK_END.finditer(text)]
    out = []
    for m, after in zip(begins, [*(x.start() for x in begins[1:]), len(text)], strict=True):
        i = bisect_right(stops, (m.end(),))
        ended = i < len(stops) and stops[i][1] <= after
        out.append((m.start(), stops[i][1] if ended else BLOCK_BODY.match(text, m.end(), after).end()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Candidate spans, by start; a run within an assigned value or a key block isn't proposed twice.

    The whole value stands for the runs in it, unless it is one run and closing punctuation.
    """
    whole = key_blocks(text)
    found = [m.span() for m in CANDIDATE.finditer(text)]
    runs, ends = set(found), dict(whole)
    starts = sorted(ends)
    within = lambda x, y: (i := bisect_right(starts, x)) > 0 and y <= ends[starts[i - 1]]
    touches = lambda x: (i := bisect_right(starts, x)) > 0 and x < ends[starts[i - 1]]
    lowered = text.lower()
    if "pass" in lowered or "pwd" in lowered or "secret" in lowered:
        values = {}
        for m in ASSIGNED.finditer(text):
            a, b = m.span(1)
            if (a, a + len(text[a:b].rstrip(CLOSING))) not in runs and not touches(a):
                values[a] = b
        ends |= values
        starts = sorted(ends)
    # Runs of dashes at a block's edges reach out of it.
    return sorted([r for r in found if not within(*r) and not touches(r[0])] + list(ends.items()))


def default_forest(language: Language | None = None) -> list[np.ndarray]:
    labelled = labelled_findings(language=language)
    return train_forest(np.array([features(t, a, b, p, language) for t, a, b, p, _ in labelled]), np.array([y for *_, y in labelled]))


def scan_secrets(docs: DataFrame, forest: list[np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, language: Language | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_candidates``, ``n_secrets`` and ``secrets``.

    ``secrets`` is an array of (start, end, score) in code points, by start. Null and empty texts have
    none; a null or absent path is empty; other columns are not needed, whatever their names. Empty input
    gives no rows. ``language`` is learned from ``docs`` unless given; a forest goes with its language.
    """
    language = learn_language(docs, text_col) if language is None else language
    forest = default_forest(language) if forest is None else forest
    path = F.col(path_col) if path_col and path_col in docs.columns else F.lit("")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            rows, where = [], []
            texts = batch.column("text").to_pylist()
            for i, (text, path) in enumerate(zip(texts, batch.column("path").to_pylist(), strict=True)):
                for a, b in candidates(text or ""):
                    rows.append(features(text, a, b, path or "", language))
                    where.append((i, a, b))
            scores = forest_scores(forest, np.array(rows)) if rows else []
            total, found = [0] * len(texts), [[] for _ in texts]
            for (i, a, b), p in zip(where, scores, strict=True):
                total[i] += 1
                if p >= threshold:
                    found[i].append({"start": a, "end": b, "score": float(p)})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, kind)], ["id", "n_candidates", "n_secrets", "secrets"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    schema = f"id {dict(docs.dtypes)[id_col]}, n_candidates bigint, n_secrets bigint, secrets array<struct<start:bigint,end:bigint,score:double>>"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
