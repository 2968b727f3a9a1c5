"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed into buckets, each with a learned vector; a document is the mean
of its vectors, and a softmax layer gives the class probabilities. Vectors and layer are learned by
stochastic gradient descent in numpy. Two more tokens take part in the mean: one for every word equal
to the word before it, and one for the document's order of length.

Scale: texts are featurised and scored where they lie, in Arrow batches without a shuffle. For scoring,
vectors and layer fold into one number per bucket, so what tasks need is one array of ``BUCKETS`` floats.
The model is learned on the driver from at most ``MAX_TRAIN`` labelled rows, featurised on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import hashed_sample, materialize
from pointloom.llm.words import word_hashes

BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4)
#: Labelled rows that the model is learned from at most, taken in order of a hash of the id.
MAX_TRAIN = 3000
#: And of their features, which the driver takes.
MAX_BYTES = 256 << 20
EPOCHS = 8
RATE = 0.5
_CHUNK = 1 << 20
_REPEAT, _LENGTHS = BUCKETS, BUCKETS + 1  # extra tokens beside the hashed ones
TOKENS = BUCKETS + 1 + 32


def _gram_ids(codes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the character n-grams that lie inside words; a blank may be the first or last character only."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    blank = codes == 32
    h, inside = np.full(m, n, np.uint32), np.ones(m, bool)
    for j in range(n):
        h = (h ^ codes[j : m + j]) * np.uint32(0x01000193)
        if 0 < j < n - 1:
            inside &= ~blank[j : m + j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16))[inside]


def token_ids(text: str | None) -> Iterator[np.ndarray]:
    """The document's tokens, in pieces of bounded size; each text has at least its length token.

    Pieces overlap by what an n-gram needs, so that the tokens don't depend on where they are cut.
    """
    text = text or ""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    yield np.array([_LENGTHS + min(31, len(words).bit_length())])
    if len(words):
        yield (words >> np.uint64(48)).astype(np.uint32)
        yield np.full(int((words[1:] == words[:-1]).sum()), _REPEAT, np.uint32)
    padded = f" {text} " if text else ""
    for at in range(0, len(padded), _CHUNK):
        codes = np.frombuffer(padded[at : at + _CHUNK + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(((codes >= 9) & (codes <= 13)), np.uint32(32), codes)
        for n in SIZES:
            yield _gram_ids(codes[: _CHUNK + n - 1], n)


def _featurise(batches):
    for batch in batches:
        ids, label = batch.column("id"), batch.column("label")
        index, weight = [], []
        for text in batch.column("text").to_pylist():
            total = np.zeros(TOKENS, np.float32)
            for t in token_ids(text):
                total += np.bincount(t, minlength=TOKENS)
            on = np.flatnonzero(total)
            index.append(on.astype(np.int32).tobytes())
            weight.append((total[on] / total.sum()).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([ids, label, pa.array(index, pa.binary()), pa.array(weight, pa.binary())], ["id", "label", "index", "weight"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5, dim: int = DIM) -> np.ndarray:
    """The log-odds of class 1 that each token adds, and the bias last; rows: (token, weight, class).

    Without rows of both classes every text scores the same.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / dim, 1 / dim, (TOKENS, dim)).astype(np.float32)
    squares = np.full((TOKENS, 1), 1e-3, np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    # AdaGrad steps: rare tokens still move when frequent ones have settled.
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            index, weight, label = rows[i]
            own = vectors[index]
            doc = weight @ own
            z = doc @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= step * np.outer(doc, p)
            bias -= step * 0.1 * p
            grad = np.outer(weight, back)
            squares[index, 0] += (grad * grad).sum(1) * 100
            vectors[index] = own - step * 10 * grad / np.sqrt(squares[index] * 100)
    return np.append(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """A model from the labelled rows of ``docs``; rows whose label or id is null or absent are not used.

    A document with both labels counts as class 0; of several rows of an id the one with the least text counts.
    At most ``max_train`` documents are sampled, and of them as many as have features of ``max_bytes`` together.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = hashed_sample(known.where("id is not null"), max_train, "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")  # max_train ids at most
    schema = f"id {dict(docs.dtypes)[id_col]}, label int, index binary, weight binary"
    # Packed, since lists of Python numbers would take the driver twenty times the memory.
    packed = materialize(chosen.mapInArrow(_featurise, schema), "features")
    before = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = packed.select("id", F.sum(F.octet_length("index") + F.octet_length("weight")).over(before).alias("_bytes"))  # max_train ids at most
    rows = sorted(packed.join(F.broadcast(sized.where(F.col("_bytes") <= max_bytes).select("id")), "id").collect())
    return train([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["weight"], np.float32), r["label"]) for r in rows])


def score(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``score``, the probability of class 1, and ``predicted``.

    Null and empty texts score by their length token alone. Columns with these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    gains, bias = model[:-1].astype(np.float32), float(model[-1])

    def run(batches):
        for batch in batches:
            out = np.empty(len(batch))
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                total, n = 0.0, 0
                for t in token_ids(text):
                    total += float(gains[t].sum(dtype=np.float64))
                    n += len(t)
                out[i] = 1 / (1 + np.exp(-np.clip(total / n + bias, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(run, schema)
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
