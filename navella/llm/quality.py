"""Document quality by supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, runs of 3 and of 5 bytes, and shapes of words (one
that repeats the word before it, in capitals, of marks only, of digits only, very long, very short), which stand for words
and pairs of words that no sample can list. A softmax layer over that mean gives the score.
Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; scoring is
linear in the features, so each bucket is folded into one number and whole texts are scored without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navella.llm.arrowtext import each_slice, span_hashes, word_spans
from navella.llm.shared import stored, with_fields
from navella.llm.tokens import text_column

BUCKETS = 1 << 17
MARKS = 8
DIMENSIONS = 16
RUNS = (3, 5)
#: Passes over the rows, at least, and steps, at least (few rows are passed over more often).
EPOCHS = 4
STEPS = 12_000
RATE = 0.5
#: Labelled rows of each class that the model is fitted on at most, those of the smallest hashes of doc_id.
SAMPLE_ROWS = 1500
SLICE = 256 << 10


def features(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, document) of all features of a slice of documents."""
    starts, ends, at = word_spans(b, off)
    words = np.diff(at)
    owner = np.repeat(np.arange(len(words)), words)
    h = span_hashes(b, starts, ends)
    mask = np.uint64(BUCKETS - 1)
    found, owners = [(h & mask).astype(np.int64)], [owner]
    repeated = np.zeros(len(h), bool)
    repeated[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((b >= 65) & (b <= 90), (b >= 97) & (b <= 122) | (b >= 128), (b >= 48) & (b <= 57))]
    upper, lower, digit = (c[ends] - c[starts] for c in sums)
    size = ends - starts
    for k, mark in enumerate((repeated, (upper > 1) & (lower == 0), (upper + lower + digit) == 0, (digit > 0) & (upper + lower == 0), size > 24, size < 3)):
        found.append(np.full(int(mark.sum()), BUCKETS + k))
        owners.append(owner[mark])
    place = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for n in RUNS:
        i = np.arange(max(0, len(b) - n + 1))
        i = i[place[i] == place[i + n - 1]] if len(i) else i
        found.append((span_hashes(b, i, i + n) & mask).astype(np.int64))
        owners.append(place[i])
    return np.concatenate(found), np.concatenate(owners)


def _counts(b: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    f, owner = features(b, off)
    order = np.argsort(owner, kind="stable")
    f, at = f[order], np.searchsorted(owner[order], np.arange(len(off)))
    for x, y in zip(at[:-1], at[1:], strict=True):
        yield np.unique(f[x:y], return_counts=True)


@dataclass
class Model:
    """score = sigmoid(mean of weight over a document's features + bias)."""

    weight: np.ndarray
    bias: float

    def scores(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        f, owner = features(b, off)
        n = len(off) - 1
        total = np.bincount(owner, self.weight[f], n)
        return 1 / (1 + np.exp(-(total / np.maximum(1, np.bincount(owner, minlength=n)) + self.bias)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, seed: int = 7) -> Model:
    """rows: (buckets, their counts, label 0 or 1) of a document. share: that of label 1 among all labelled rows.
    With one class alone, or none, every score is the share."""
    y = np.array([r[2] for r in rows])
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    if len(rows) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS + MARKS, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + MARKS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    shares = [(f, (c / c.sum()).astype(np.float32)) if len(f) else (f, c.astype(np.float32)) for f, c, _ in rows]
    steps = max(EPOCHS, -(-STEPS // len(rows))) * len(rows)
    for k in range(steps):
        if k % len(rows) == 0:
            order = rng.permutation(len(rows))
        i = order[k % len(rows)]
        f, c = shares[i]
        rate = RATE * (1 - k / steps)
        x = c @ vectors[f]
        z = x @ layer + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        pull = layer @ p  # the loss's gradient by the mean; by a feature's vector it is that times the feature's share
        layer -= rate * np.outer(x, p)
        bias -= rate * p
        vectors[f] -= rate * c[:, None] * pull
    fitted = float(np.log(y.mean() / (1 - y.mean())))
    slope = layer[:, 1] - layer[:, 0]
    return Model((vectors @ slope).astype(np.float32), float(bias[1] - bias[0]) + prior - fitted)


def labels_of(labels: DataFrame, label: str, learn) -> DataFrame:
    """(doc_id, y) of the labels 0 and 1 whose doc_id isn't null and fulfils learn, one row an id: of several labels 1
    counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y) of at most rows labelled documents of each class, those of the smallest hashes of doc_id, and
    the share of label 1 among all that may be learned from. learn: condition on doc_id. Null texts are empty."""
    known = stored(labels_of(labels, label, learn), "labels")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    picked = [known.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * rows pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.join(ids, "doc_id"), ones / n if n else 0.5


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample (2 * rows documents at most; of each the counts of all its features, of
    which there are BUCKETS + MARKS, come to the driver). Labels other than 0 and 1 and null ids are
    not looked at; of several labels of an id 1 counts; repeated rows of an id are learned from each. With one class
    alone, or none, every score is the share of label 1 (one half without labels)."""
    sample, share = labelled_sample(docs, labels, label, learn, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in each_slice(batch.column("text"), SLICE):
                found = list(_counts(b, off))
                at = pa.array(np.concatenate([[0], np.cumsum([len(f) for f, _ in found])]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int32))) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *lists, batch.column("y").slice(i, j - i)], names=["doc_id", "f", "c", "y"])

    got = sample.mapInArrow(count, "doc_id long, f array<int>, c array<int>, y int").toArrow()
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))
    arrays = (got.column(c) for c in ("f", "c", "y"))
    return train([(f.values.to_numpy(), c.values.to_numpy(), y.as_py()) for f, c, y in zip(*arrays, strict=True)], share)


def score(docs: DataFrame, model) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted, in the place of any columns of these names.
    model: what has scores(bytes, offsets). Null texts count as empty; an empty text has no feature and gets the score of the
    model's bias."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, whatever the corpus

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores_of(batch.column("text"), shared.value)
            columns = [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(judge, with_fields(docs.schema, "score double, predicted int"))


def scores_of(texts: pa.Array, model) -> np.ndarray:
    parts = [model.scores(b, off) for _, _, b, off in each_slice(texts, SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def kept(docs: DataFrame, model, predicted: int) -> DataFrame:
    """The rows of docs of a predicted class, with all their columns. Null texts count as empty; repeated rows stay or go
    each by its text; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array((scores_of(batch.column("text"), shared.value) >= 0.5) == bool(predicted)))

    return docs.mapInArrow(sift, docs.schema)
