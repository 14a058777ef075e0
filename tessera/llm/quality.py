"""A quality classifier with learned subword embeddings.

A document is the average of the learned vectors of its words, word pairs and
three-byte grams (hashed into 2 ** BITS buckets; pairs of one word twice share one); a softmax over the classes 0 and 1 follows.
Vectors and output weights are trained together by plain stochastic gradient
descent in numpy, one document a step with a falling step size, on a sample of
at most ``PER_CLASS`` labelled documents a class (those first in a seeded order of
ids; all fit into the driver because features are bounded by the buckets).

Scoring needs only, for each bucket, the difference that its vector makes
between the two classes' outputs, so the broadcast model is one number a bucket.

Defined cases: rows without an id, or whose id falls in the held-out fold, are
never learned from; labels that are null are ignored, and so is an id labelled both 0 and 1; a text without a word or
gram is scored by the classes' biases; without two classes to learn, every score
is the share of label 1 among those learned (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import Features, sampled_features, seeded_order
from tessera.llm.shared import held_out
from tessera.llm.vectors import slices

BITS, DIMS, GRAMS = 16, 8, (3,)
PER_CLASS, EPOCHS, STEP = 2000, 8, 0.1
SPEC = {"grams": GRAMS, "bits": BITS, "words": True, "lower": False}


def training_sample(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, quality): at most ``per_class`` labelled ids a class, outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    parts = [known.where(F.col("quality") == c).orderBy(seeded_order(F.col("doc_id"), "quality"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].union(parts[1])


def train(rows: list[tuple], seed: int = 5) -> tuple[np.ndarray, float]:
    """(difference by bucket, bias) from rows of (label, buckets, counts)."""
    y = np.array([int(r[0]) for r in rows])
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
    out, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))  # classes count alike
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            _, ids, counts = rows[i]
            rate = np.float32(STEP * (1 - done / steps))
            done += 1
            share = (counts / counts.sum())[:, None] if len(counts) else counts[:, None]
            mean = (vectors[ids] * share).sum(axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p * np.float32(0.1)
            # the mean's gradient reaches a vector times its share; steps are scaled
            # by the number of buckets in the text, as if each came up once
            vectors[ids] -= rate * np.minimum(share * len(ids), 4) * back
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every whole text; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, bias = shared.value
        for part in slices(batches, 1):
            f = Features(part.column(1), **SPEC)
            z = np.empty(part.num_rows)
            for i in range(part.num_rows):
                ids = f.text(i)
                z[i] = by_bucket[ids].mean(dtype=np.float64) + bias if len(ids) else bias
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), trained on the labelled documents outside the held-out fold."""
    model = train(sampled_features(docs, training_sample(labels), "quality", **SPEC))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
