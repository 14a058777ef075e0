"""Language identification in two steps.

First the language family, by a softmax over families; then, within the family,
one-versus-one linear support vector machines, one for each pair of its
languages, vote (ties go to the larger sum of margins). Both are linear in the
shares of a text's lower-cased one- to four-byte grams, hashed into
2 ** BITS buckets, and trained by stochastic gradient descent in numpy on at most
``PER_LANGUAGE`` documents a language (first in a seeded order of ids).

A value's language is its part before ``-`` or ``_``, in lower case (``pt-BR`` is
``pt``); one that ``FAMILIES`` doesn't list is a family of its own.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
documents with a null lang, a null id or an id of the held-out fold are never
learned from; with nothing to learn from, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import Features, sampled_features, seeded_order
from tessera.llm.shared import held_out, saved
from tessera.llm.vectors import slices

BITS, GRAMS = 15, (1, 2, 3, 4)
PER_LANGUAGE, EPOCHS = 500, 10
SPEC = {"grams": GRAMS, "bits": BITS, "words": False, "lower": True}
#: Shares are small numbers; the models see them times this.
SCALE = np.float32(30.0)

# Families by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "celtic": ["br", "cy", "ga", "gd", "gv", "kw"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "uz"],
    "semitic": ["ar", "he", "mt"],
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in FAMILIES.items() if code in members), code)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang): at most ``per_language`` ids a language, outside the held-out fold.

    Ids are thinned by their seeded order in proportion to the language's count
    first, so that ranking them needs no large group.
    """
    turn = seeded_order(F.col("doc_id"), "language")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", turn.alias("turn"))
    known = saved(known, "languages")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / float(1 << 32)
    thin = known.join(F.broadcast(counts), "lang").where(place * F.col("n") < 2 * per_language + 20)  # one row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id"))
    return thin.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct()


def _shares(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(ids, SCALE * counts / max(counts.sum(), 1)) for _, ids, counts in rows]


def _softmax(x: list, y: np.ndarray, classes: int, rng) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((1 << BITS, classes), np.float32), np.zeros(classes, np.float32)
    weight = len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))
    steps, done = EPOCHS * len(x), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            rate = np.float32(0.5 * (1 - done / steps))
            done += 1
            ids, v = x[i]
            z = v @ w[ids] + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            w[ids] -= rate * np.outer(v, p)
            b -= rate * p * np.float32(0.1)
    return w, b


def _machine(x: list, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
    """Linear SVM (y is -1 or 1): hinge loss with weight decay, averaged over the second half of the steps."""
    w, b = np.zeros(1 << BITS, np.float32), 0.0
    total, total_b, steps, done, decay = np.zeros(1 << BITS, np.float64), 0.0, EPOCHS * len(x), 0, 1e-4
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(x)):
            rate = 0.5 * (1 - done / steps)
            done += 1
            ids, v = x[i]
            if y[i] * (v @ w[ids] + b) < 1:
                w[ids] += np.float32(rate * y[i]) * v
                b += rate * y[i] * 0.1
        w *= np.float32(1 - decay * len(x))
        if epoch >= EPOCHS // 2:
            total += w
            total_b += b
    n = EPOCHS - EPOCHS // 2
    return (total / n).astype(np.float32), total_b / n


def train(rows: list[tuple], seed: int = 7) -> dict | None:
    """Weights (bucket, output), biases and what the outputs mean; None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({r[0] for r in rows})
    families = sorted({family(x) for x in langs})
    x, own = _shares(rows), np.array([langs.index(r[0]) for r in rows])
    weights, biases = [], []
    if len(families) > 1:
        w, b = _softmax(x, np.array([families.index(family(r[0])) for r in rows]), len(families), rng)
        weights.append(w)
        biases.extend(b)
    pairs = [(i, j) for i, j in combinations(range(len(langs)), 2) if family(langs[i]) == family(langs[j])]
    for i, j in pairs:
        pick = np.flatnonzero((own == i) | (own == j))
        w, b = _machine([x[k] for k in pick], np.where(own[pick] == i, 1.0, -1.0), rng)
        weights.append(w[:, None])
        biases.append(b)
    table = np.concatenate(weights, axis=1) if weights else np.zeros((1 << BITS, 0), np.float32)
    return {"langs": langs, "families": families, "pairs": pairs, "weights": table * SCALE, "biases": np.array(biases, np.float32)}


def decide(model: dict, outputs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of outputs."""
    langs, families = model["langs"], model["families"]
    n = len(outputs)
    k = len(families) if len(families) > 1 else 0
    z = outputs[:, :k] - outputs[:, :k].max(axis=1, keepdims=True) if k else np.zeros((n, 1))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    chosen = p.argmax(axis=1)
    votes, margins = np.zeros((n, len(langs))), np.zeros((n, len(langs)))
    for m, (i, j) in enumerate(model["pairs"]):
        f = np.clip(outputs[:, k + m], -30, 30)
        votes[:, i] += f >= 0
        votes[:, j] += f < 0
        margins[:, i] += f
        margins[:, j] -= f
    member = np.array([[family(x) == f for x in langs] for f in families])[chosen]
    key = np.where(member, votes * 1e4 + margins, -np.inf)
    best = key.argmax(axis=1)
    rivals = np.maximum(member.sum(axis=1) - 1, 1)
    sure = np.where(member.sum(axis=1) > 1, 1 / (1 + np.exp(-2 * margins[np.arange(n), best] / rivals)), 1.0)
    return [langs[i] for i in best], p[np.arange(n), chosen] * sure


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets times outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, 1):
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                texts = rows.column(1)
                f = Features(texts, **SPEC)
                letters = [bool(_has_letter(f, i)) for i in range(len(texts))]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if model is not None:
                    # one text's shares at a time: a vector of 2 ** BITS, never a matrix of texts
                    z = np.tile(model["biases"], (len(texts), 1))
                    for i in range(len(texts)):
                        ids = f.text(i)
                        if len(ids):
                            z[i] += (np.bincount(ids, minlength=1 << BITS) / np.float32(len(ids))).astype(np.float32) @ model["weights"]
                    names, scores = decide(model, z)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([n if ok else "und" for n, ok in zip(names, letters)]), pa.array([float(s) if ok else 0.0 for s, ok in zip(scores, letters)])],
                    names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def _has_letter(f: Features, i: int) -> bool:
    a, z = f.words.text_at[i:i + 2]
    data = f.words.data[a:z]
    folded = data | 0x20
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8")))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents outside the held-out fold."""
    model = train(sampled_features(docs, training_sample(docs), "lang", **SPEC))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
