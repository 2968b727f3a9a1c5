"""Personal data by weak supervision.

Patterns propose spans. Several labelers vote on each: its format, a gazetteer, cue words near it and a
check of its digits say yes, no or nothing. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each proposal. A logistic span classifier is then
trained on those likelihoods; it sees no votes but the span's characters, its length and the words beside
it, and it alone decides which further spans are added. Spans of the four base kinds have fixed rules and
always stay.

The gazetteer is learned from the corpus: of the terms that spans of a family carry (the last part of an
e-mail's host, the given name, the dialling, area or land code) those are listed that make up at least
``LISTED_SHARE`` of the family's spans, so there are at most 1 / ``LISTED_SHARE`` of them.

Scale: one pass over the texts proposes spans, without a shuffle; what follows reads the proposals only.
Gazetteer and patterns are counts over the whole corpus: a pattern is a kind, four votes and two neighbour
classes, so there are at most ``len(KINDS) * 3**4 * 16`` of them. The classifier is trained on a bounded
sample of ``MAX_SPANS`` proposals and is one array of numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_spelled", "phone_local", "iban", "ssn", "ipv6", "person")
KINDS = BASE_KINDS + ADDED_KINDS

# Fixed patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Proposals beyond them.
SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,63}){1,4}")
LOCAL = re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?")

#: Share of a family's spans that a term of the gazetteer makes up at least; families of fewer spans have none.
LISTED_SHARE, LISTED_SPANS = 0.002, 50
#: Proposals that the classifier is trained on at most, taken in order of a hash.
MAX_SPANS = 20_000
#: Hashed features of the classifier.
WIDTH = 1 << 14

# Cue words of the context labeler.
CUES = {
    "email": ("mail", "contact", "kontakt", "correo", "write"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "teléfono", "téléphone"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
    "person": ("name", "signed", "author", "patient"),
}
_CUE_OF = {"email_spelled": "email", "phone_local": "phone", "ipv6": "ip"}
_NEAR = 40
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    """As the pattern's leftmost non-overlapping matches: each starts where the run before an @ does."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    """As the pattern's leftmost non-overlapping matches: each chain of parts gives them by fours."""
    for m in _CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, four
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans; a match that fails its test is dropped without another try."""
    out = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for a, b, parts in _ips(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append(("ip", a, b))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def added_proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposals of the other kinds that touch no base span; the first of those that overlap."""
    found = []
    for kind, pattern, need in (("email_spelled", SPELLED, "at"), ("phone_local", LOCAL, None), ("iban", IBAN, None), ("ssn", SSN, "-"), ("ipv6", IPV6, ":"), ("person", PERSON, None)):
        if need is None or need in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    taken, out = sorted((a, b) for _, a, b in base), []
    starts, ends = (np.array([t[i] for t in taken], np.int64) for i in (0, 1))
    ends, last = np.maximum.accumulate(ends), 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        i = int(np.searchsorted(starts, b)) - 1  # the last base span that starts before the end
        if a >= last and (i < 0 or ends[i] <= a):
            out.append((kind, a, b))
            last = b
    return out


def family_of(kind: str) -> str:
    return _CUE_OF.get(kind, kind)


def term_of(kind: str, span: str) -> str:
    """What the gazetteer knows a span by; empty where its kind has nothing of that sort."""
    if family_of(kind) == "email":
        return re.split(r"\W+", span.lower().strip(")]"))[-1]
    if kind == "phone":
        return re.split("[^0-9]", span[1:], maxsplit=1)[0][:3]
    if kind == "phone_local":
        return "".join(c for c in span if c in "0123456789")[:3]
    if kind == "iban":
        return span[:2]
    if kind == "person":
        return (span.split() + [""])[1]
    if kind == "ip":
        return span.split(".")[0]
    return ""


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, int, int]:
    """Format, context and check labelers: 1 yes, -1 no, 0 nothing."""
    span, family = text[a:b], family_of(kind)
    left, right = text[max(0, a - 1) : a], text[b : b + 1]
    form = -1 if (left.isalnum() or right.isalnum()) else 1
    digits = "".join(c for c in span if c in "0123456789")
    near = text[max(0, a - _NEAR) : a].lower()
    cue = 1 if any(c in re.findall(r"\w+", near) or f"{c}:" in near for c in CUES.get(family, ())) else 0
    check = 0
    if kind == "card":
        check = 1 if len(set(digits)) > 3 else -1
    elif kind == "iban":
        check = 1 if _iban_holds(span) else -1
    elif kind == "ssn":
        check = 1 if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else -1
    elif family == "phone":
        check = 1 if len(set(digits)) > 3 else -1
    elif kind == "ip":
        check = 1 if all(str(int(p)) == p for p in span.split(".")) and not span.startswith(("0.", "127.", "255.")) else -1
    return form, cue, check


def _class_of(c: str) -> str:
    return "s" if not c or c.isspace() else "d" if c.isdigit() else "w" if c.isalpha() else "p"


def pattern_of(text: str, kind: str, a: int, b: int) -> str:
    """Kind, votes but for the gazetteer's, and the classes of the neighbouring characters, as one key."""
    return kind + "|" + "".join("+" if v > 0 else "-" if v else "0" for v in votes(text, kind, a, b)) + "|" + _class_of(text[max(0, a - 1) : a]) + _class_of(text[b : b + 1])


def span_features(text: str, kind: str, a: int, b: int) -> list[int]:
    """What the classifier sees, hashed: the kind, the shape and length of the span, its characters, the words beside it."""
    span = text[a:b]
    shape = re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", span[:200])))[:24]
    before = re.findall(r"\w+", text[max(0, a - _NEAR) : a].lower())[-3:]
    after = re.findall(r"\w+", text[b : b + _NEAR].lower())[:2]
    found = [f"k {kind}", f"s {kind} {shape}", f"n {kind} {min(40, b - a)}", f"l {kind} {_class_of(text[max(0, a - 1) : a])}", f"r {kind} {_class_of(text[b : b + 1])}"]
    found += [f"b {kind} {w}" for w in before] + [f"a {kind} {w}" for w in after] + [f"c {kind} {span[i : i + 2]}" for i in range(min(len(span) - 1, 12))]
    found += [f"d {kind} {'many' if len(set(span)) > 6 else 'few'}", f"v {kind} {_iban_holds(span) if kind == 'iban' else ''}"]
    return sorted({crc32(f.encode("utf-8", "surrogatepass")) % WIDTH for f in found})


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("pattern", pa.string()), ("term", pa.string()), ("features", pa.list_(pa.int32()))])


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``base`` and ``added`` spans with their patterns, terms and features. Null text has none."""

    def described(text: str, k: str, a: int, b: int) -> dict:
        return {"start": a, "rank": KINDS.index(k), "end": b, "kind": k, "pattern": pattern_of(text, k, a, b), "term": term_of(k, text[a:b])[:64], "features": span_features(text, k, a, b)}

    def run(batches):
        for batch in batches:
            both = [[], []]
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                for out, spans in zip(both, (base, added_proposals(text, base)), strict=True):
                    out.append([described(text, *s) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.list_(_SPAN)) for x in both)], ["id", "base", "added"])

    span = "array<struct<start:bigint,rank:int,end:bigint,kind:string,pattern:string,term:string,features:array<int>>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, base {span}, added {span}").withColumnRenamed("id", id_col)


def gazetteer(every: DataFrame) -> tuple[dict[str, int], dict[str, list[str]]]:
    """Spans of each family, and its terms that make up a share of ``LISTED_SHARE`` of them or more."""
    family = F.col("s.kind")
    for kind, of in _CUE_OF.items():
        family = F.when(F.col("s.kind") == kind, of).otherwise(family)
    terms = every.groupBy(family.alias("family"), F.col("s.term").alias("term")).count()
    sizes = {r[0]: r[1] for r in terms.groupBy("family").agg(F.sum("count")).collect()}  # a row per family
    least = F.lit(None)
    for name, n in sizes.items():
        least = F.when(F.col("family") == name, F.lit(max(3, n * LISTED_SHARE))).otherwise(least)
    found: dict[str, list[str]] = {name: [] for name in sizes}
    for r in terms.where((F.col("count") >= least) & (F.col("term") != "")).collect():  # bounded by the share
        found[r["family"]].append(r["term"])
    return sizes, {k: sorted(v) for k, v in found.items()}


def with_gazetteer(spans: Column, sizes: dict[str, int], terms: dict[str, list[str]]) -> Column:
    """The spans with the gazetteer's vote put into their patterns, after the format's."""

    def put(s: Column) -> Column:
        vote = F.lit("0")
        for kind in KINDS:
            family = family_of(kind)
            if sizes.get(family, 0) >= LISTED_SPANS and terms.get(family):
                vote = F.when((s["kind"] == kind) & (s["term"] != ""), F.when(s["term"].isin(terms[family]), "+").otherwise("-")).otherwise(vote)
        at = F.instr(s["pattern"], "|")
        return s.withField("pattern", F.concat(F.substring(s["pattern"], F.lit(1), at + 1), vote, F.substring(s["pattern"], at + 2, F.length(s["pattern"]))))

    return F.transform(spans, put)


def estimate_reliabilities(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """EM over pattern counts: each pattern's likelihood of being personal data; each labeler's share of right votes.

    A labeler has a distribution of its votes (yes, nothing, no) on true and one on false proposals, so that one
    that says the same of all tells nothing; a kind has a prior. All are smoothed towards labelers that are
    right more often than not, and the first likelihoods are majority votes. No patterns give an empty result.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["+0-".index(c) for c in k.split("|")[1]] for k in keys], int).reshape(-1, 4)
    kind = np.array([KINDS.index(k.split("|")[0]) for k in keys], int)
    p = 1 / (1 + np.exp(-(1 - v).sum(1) + 0.5))
    smooth = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]]) * (1 + 0.002 * n.sum())
    says, prior = np.zeros((2, 4, 3)), np.full(len(KINDS), 0.5)
    for _ in range(rounds if keys else 0):
        for c, own in enumerate((n * p, n * (1 - p))):
            for j in range(4):
                says[c, j] = np.bincount(v[:, j], own, 3) + smooth[c]
        log = np.log(says / says.sum(2, keepdims=True))
        for k in range(len(KINDS)):
            on = kind == k
            prior[k] = np.clip(((n * p)[on].sum() + 1) / (n[on].sum() + 2), 0.05, 0.95)
        odds = np.log(prior / (1 - prior))[kind] + sum(log[0, j, v[:, j]] - log[1, j, v[:, j]] for j in range(4))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    right = np.ones(4)
    for j in range(4):
        if (on := v[:, j] != 1).any():
            right[j] = (n * np.where(v[:, j] == 0, p, 1 - p))[on].sum() / n[on].sum()
    return dict(zip(keys, p.tolist(), strict=True)), right


def _matrix(features: list[list[int]]) -> np.ndarray:
    """One row of weights' places for each list: its features, the bias, and a place without weight to fill up."""
    out = np.full((len(features), max(map(len, features), default=0) + 1), WIDTH + 1)
    for row, f in zip(out, features, strict=True):
        row[: len(f)] = f
        row[-1] = WIDTH
    return out


def span_scores(weights: np.ndarray, features: list[list[int]]) -> np.ndarray:
    """The classifier's probability for each list of features."""
    return 1 / (1 + np.exp(-np.clip(weights[_matrix(features)].sum(1), -30, 30)))


def train_span_classifier(features: list[list[int]], likely: list[float], epochs: int = 30, rate: float = 0.3, batch: int = 64, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression fitted to the likelihoods, by AdaGrad; without rows all are 0.

    The last weight but one is the bias; the last stays 0.
    """
    w, squares = np.zeros(WIDTH + 2), np.full(WIDTH + 2, 1e-2)
    rng, x, y = np.random.Generator(np.random.PCG64(seed)), _matrix(features), np.array(likely, float)
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            f = x[order[a : a + batch]]
            miss = 1 / (1 + np.exp(-np.clip(w[f].sum(1), -30, 30))) - y[order[a : a + batch]]
            at, where = np.unique(f, return_inverse=True)
            g = np.bincount(where.ravel(), np.repeat(miss, f.shape[1]), len(at)) / len(f)
            squares[at] += g * g
            w[at] -= rate * (g / np.sqrt(squares[at]) + 1e-4 * w[at])
            w[-1] = 0
    return w


_SCORED = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` spans, and all ``spans`` with those the method adds.

    Null and empty texts have none; equal rows give equal results; other columns are not needed. Empty input
    gives no rows.
    """
    found = materialize(propose(docs, id_col, text_col), "proposals")
    sizes, terms = gazetteer(found.select(F.explode(F.concat("base", "added")).alias("s")))
    voted = found.select(id_col, *(with_gazetteer(F.col(c), sizes, terms).alias(c) for c in ("base", "added")))
    every = voted.select(F.col(id_col).alias("id"), F.explode(F.concat("base", "added")).alias("s"))
    patterns = {r[0]: r[1] for r in every.groupBy("s.pattern").count().collect()}  # bounded, see above
    likely, _ = estimate_reliabilities(patterns)
    # Of each kind as many proposals as of any other at most, so that rare kinds are learned too.
    most, parts, counts = MAX_SPANS // len(KINDS), 1 << 30, Counter()
    for k, n in patterns.items():
        counts[k.split("|")[0]] += n
    limit = F.lit(parts)
    for kind, n in counts.items():  # a threshold from the count, so that only about so many are sent
        limit = F.when(F.col("kind") == kind, F.lit(int(min(1.0, (most + 6 * most**0.5) / n) * parts))).otherwise(limit)
    own = every.select("s.kind", "s.pattern", "s.features", F.pmod(F.xxhash64("id", "s.start", "s.kind"), F.lit(parts)).alias("h"))
    rows, taken = [], Counter()
    for r in sorted(own.where(F.col("h") < limit).collect(), key=lambda r: (r["h"], r["kind"], r["pattern"], r["features"])):
        taken[r["kind"]] += 1
        if taken[r["kind"]] <= most:
            rows.append(r)
    weights = train_span_classifier([r["features"] for r in rows], [likely[r["pattern"]] for r in rows])
    kind_of = dict(docs.dtypes)[id_col]

    def decide(batches):
        for batch in batches:
            kept = []
            for spans in batch.column("added").to_pylist():
                p = span_scores(weights, [s["features"] for s in spans])
                kept.append([{k: s[k] for k in ("start", "rank", "end", "kind")} | {"score": float(x)} for s, x in zip(spans, p, strict=True) if x >= accept])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), pa.array(kept, _SCORED)], ["id", "base", "added"])

    plain = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], F.lit(1.0).alias("score"))).alias("base")
    schema = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"
    out = found.select(F.col(id_col).alias("id"), plain, "added").mapInArrow(decide, f"id {kind_of}, base {schema}, added {schema}")
    return out.select(F.col("id").alias(id_col), "base", F.concat("base", "added").alias("spans"))
