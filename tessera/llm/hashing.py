"""Hashed n-gram features of Arrow text slices, for the trained operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import _LOWER, U, Words, slices

#: Odd factors of the bytes of a gram, and of the sum.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def gram_ids(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes from each position on."""
    size = max(0, len(data) - n + 1)
    h = np.full(size, n, np.uint32)
    for j in range(n):
        h ^= (data[j:j + size].astype(np.uint32) + np.uint32(1)) * _FACTORS[j]
        h = (h << np.uint32(5)) | (h >> np.uint32(27))
    h *= _FACTORS[0]
    return h >> np.uint32(32 - bits)


class Features:
    """Buckets of the words and word pairs (optional) and byte n-grams of each text of a slice.

    ``text(i)`` lists the buckets of text i, one for each word, pair and gram.
    """

    def __init__(self, texts: pa.Array, grams: tuple[int, ...], bits: int, words: bool, lower: bool):
        self.words = Words(texts, lower=lower, hashed=words)
        data = _LOWER[self.words.data] if lower else self.words.data
        self.grams = [(n, gram_ids(data, n, bits)) for n in grams]
        self.word_ids = None
        if words:
            h = self.words.hash
            self.word_ids = (h >> U(64 - bits)).astype(np.uint32)
            # two-word grams: all pairs of one word twice share a bucket
            self.pair_ids = ((h[:-1] * U(31) + h[1:]) >> U(64 - bits)).astype(np.uint32)
            self.pair_ids[h[:-1] == h[1:]] = 0

    def text(self, i: int) -> np.ndarray:
        a, z = self.words.text_at[i:i + 2]
        parts = [ids[a:max(a, z - n + 1)] for n, ids in self.grams]
        if self.word_ids is not None:
            first, last = self.words.first[i:i + 2]
            parts += [self.word_ids[first:last], self.pair_ids[first:max(first, last - 1)]]
        return np.concatenate(parts)


def sampled_features(docs: DataFrame, sample: DataFrame, label: str, **spec) -> list[tuple]:
    """(label, buckets, counts) of the sampled documents, in order of id.

    ``sample`` (doc_id, label) has a bounded number of rows, so it is broadcast,
    and a row's features are bounded by the number of buckets. Where the label is a
    column of ``docs``, only rows of that label are met, so that rows which share an
    id are learned under their own.
    """
    own = ["doc_id", label] if label in docs.columns else ["doc_id"]
    met = docs.select(*own, "text").join(F.broadcast(sample.select("doc_id", label)), own).select("doc_id", "text", F.col(label).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            f = Features(part.column(1), **spec)
            found = [np.unique(f.text(i), return_counts=True) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([u.astype("<u4").tobytes() for u, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                names=["doc_id", "label", "buckets", "counts"])

    rows = met.mapInArrow(run, "doc_id long, label string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["buckets"])))
    return [(r["label"], np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float32)) for r in rows]


def seeded_order(doc_id, seed: str):
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary"))
