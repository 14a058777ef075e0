"""Toxicity by weak supervision.

Many weak voters look at a bounded sample of labelled documents; a generative model
of their votes tells how far each can be trusted; a linear classifier learns from
the model's posterior labels and scores every whole text.

1. Sample: at most ``PER_CLASS`` labelled ids a class (first in a seeded order of ids,
   outside the held-out fold), each with its whole text. Of texts of a class that
   share one of ``SKETCH`` minimum shingle hashes (copies and near copies) one is
   learned from, or else the words of a much copied text would pass for signs.
2. Voters. Lexicon voters hold words, beginnings of words, or beginnings that two
   different words of a text share, that the sample's labels set apart (by their
   likelihood ratio and ``TIMES`` the rate of clean texts, at most ``ENTRIES`` of a
   kind); the entries of a kind are dealt to ``PARTS`` voters. Pattern voters are fixed
   expressions. A voter fires on a text or stays silent.
3. Label model. A document's unseen class makes voters fire; within a class, voters
   depend on each other along a tree of their strongest correlations (largest mutual
   information given the class). Expectation maximisation estimates the class
   share, each voter's rates of firing in both classes, and the tree with its
   dependent rates. The labels of one half of the sample (by a hash of the id) keep
   the classes from turning into something else that voters agree on, such as the
   language; for the other half votes alone decide. Every document, of either half,
   then gets the class that its votes speak for. Voters that fire alike in both
   classes have no say; voters that repeat each other count once.
4. Classifier. Features are the hashed words, word pairs and four- and five-byte
   grams that a text holds once or ``OFTEN`` times. Those that differ most between
   posterior classes (by the same two measures, at most ``FEATURES``) get weights
   by gradient descent on the posterior labels, the others none. The broadcast model has FEATURES numbers at most.

Defined cases: rows without an id, or whose id falls in the held-out fold, are
never learned from; null labels are ignored, and so is an id labelled both 0 and 1; if
rows share a sampled id, the text with the smallest hash is learned; a null or empty
text holds no feature and gets the score of the bias; without a toxic and a clean
document to learn from, every score is 0 (or 1, if all that was learned is toxic).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import Features, seeded_order
from tessera.llm.shared import held_out, saved
from tessera.llm.vectors import U, Words, mix, shingles, slices

PER_CLASS, ENTRIES, PARTS, FEATURES = 2000, 256, 4, 4096
#: Likelihood ratio (G squared) that an entry or feature has at least, and documents of the class it is found in.
LEAST_RATIO, SUPPORT = 15.0, 3
#: Rate in one class over that in the other; occurrences that make a second feature.
TIMES, OFTEN = 6.0, 3
#: Minimum hashes that tell copies.
SKETCH = 4
ROUNDS, STEPS, PENALTY = 40, 600, 2e-4
SPEC = {"grams": (4, 5), "bits": 32, "words": True, "lower": True}

# Expressions of the pattern voters.
PATTERNS = {
    "insults": r"(?iu)(?<!\p{L})(?:idiots?|morons?|losers?|scum|stupid|pathetic|worthless|disgusting|trash|clowns?|dumb|fools?|jerks?|liars?)(?!\p{L})",
    "threats": r"(?iu)(?<!\p{L})(?:shut up|go away|get lost|hate you|hurt you|kill you|drop dead)(?!\p{L})",
    "shouting": r"\p{Lu}{4,}\P{L}+\p{Lu}{4,}",
    "exclaiming": r"!{2,}",
    "masked": r"(?<!\S)\p{L}+[*@#$]+\p{L}+",
}
#: Kinds of entries: letters of the beginning (all: None), different words of the text that must share it.
KINDS = {"word": (None, 1), "first 4": (4, 1), "first 6": (6, 1), "first 5 of two": (5, 2)}
VOTERS = [f"{kind} {p}" for kind in KINDS for p in range(PARTS)] + list(PATTERNS)
LEXICON_VOTERS = len(KINDS) * PARTS


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled ids a class."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("most")).where("label = most").select("id", "label")
    parts = [known.where(F.col("label") == c).orderBy(seeded_order(F.col("id"), "toxic"), "id").limit(per_class) for c in (0, 1)]
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = texts.join(F.broadcast(parts[0].union(parts[1])), F.col("doc_id") == F.col("id"))  # 2 * per_class rows
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one document of those of a class that share a minimum of their shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            words = Words(part.column(2), lower=True)
            sets = [shingles(words, i) for i in range(part.num_rows)]
            least = [[int(mix(s ^ U(k + 1)).min() >> U(1)) for k in range(SKETCH)] if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "label", "least"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, least array<long>").collect()  # PER_CLASS ids a class
    seen: set[tuple] = set()
    kept = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own = {(r["label"], k, m) for k, m in enumerate(r["least"])}
        if not own & seen:
            kept.append((r["doc_id"],))
        seen |= own
    stay = sample.sparkSession.createDataFrame(kept, "id long")
    return sample.join(F.broadcast(stay), F.col("doc_id") == F.col("id")).drop("id")


def ratio(pos: Column, n: Column, n_pos: Column, n_all: Column) -> Column:
    """G squared of a feature held by ``pos`` toxic documents of ``n``, out of n_pos of n_all."""
    def cell(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n_all / (row * column))).otherwise(0.0)
    neg, left = n_all - n_pos, n_all - n
    return 2 * (cell(pos, n, n_pos) + cell(n - pos, n, neg) + cell(n_pos - pos, left, n_pos) + cell(neg - n + pos, left, neg))


def entries_of(sample: DataFrame) -> DataFrame:
    """(doc_id, label, kind, entry): the distinct words, and beginnings of words, of each text."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))).alias("word")
    words = sample.select("doc_id", "label", word).where(F.length("word") >= 3)
    kinds = [F.when(F.lit(size is None) | (F.length("word") > F.lit(size or 0)),
                    F.struct(F.lit(k).alias("kind"), F.lit(least).alias("least"), (F.col("word") if size is None else F.substring("word", 1, size)).alias("entry")))
             for k, (size, least) in enumerate(KINDS.values())]
    one = words.select("doc_id", "label", F.explode(F.array_compact(F.array(*kinds))).alias("e"))
    return one.groupBy("doc_id", "label", "e.kind", "e.least", "e.entry").agg(F.count(F.lit(1)).alias("n")).where("n >= least").select("doc_id", "label", "kind", "entry")


def apart(pos: Column, n: Column, n_pos: float, n_all: float) -> Column:
    """True if a feature is TIMES as frequent in one class as in the other."""
    rate, other = (pos + 0.5) / (n_pos + 1), (n - pos + 0.5) / (n_all - n_pos + 1)
    return F.greatest(rate, other) >= TIMES * F.least(rate, other)


def lexicons(entries: DataFrame, n_pos: int, n_all: int) -> DataFrame:
    """(kind, entry, voter): entries that point at toxic texts, dealt to the voters of their kind."""
    counts = entries.groupBy("kind", "entry").agg(F.sum("label").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    g = counts.where((F.col("pos") >= SUPPORT) & apart(F.col("pos"), F.col("n"), n_pos, n_all) & (F.col("pos") * n_all > F.col("n") * n_pos)).withColumn(
        "g", ratio(F.col("pos"), F.col("n"), F.lit(float(n_pos)), F.lit(float(n_all)))).where(F.col("g") >= LEAST_RATIO)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("g"), "entry"))
    return g.withColumn("rank", rank).where(F.col("rank") <= ENTRIES).select(
        "kind", "entry", (F.col("kind") * PARTS + (F.col("rank") - 1) % PARTS).cast("int").alias("voter"))


def votes(sample: DataFrame, entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, label, mask): bit j is set if voter j fires."""
    fired = entries.join(F.broadcast(lexicon), ["kind", "entry"]).groupBy(F.col("doc_id").alias("id")).agg(  # ENTRIES rows a kind
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("voter"))).alias("fired"))
    seen = [F.when(F.col("text").rlike(p), F.lit(1 << (LEXICON_VOTERS + j))).otherwise(F.lit(0)).cast("long") for j, p in enumerate(PATTERNS.values())]
    mask = F.coalesce("fired", F.lit(0).cast("long"))
    for s in seen:
        mask = mask.bitwiseOR(s)
    return sample.join(fired, F.col("doc_id") == F.col("id"), "left").select("doc_id", "label", mask.alias("mask"))


class LabelModel:
    """Two classes, each with a tree of dependent voters; fitted by expectation maximisation."""

    def __init__(self, fires: np.ndarray, anchors: np.ndarray, rounds: int = ROUNDS):
        """``anchors``: the class of the documents whose label is given, NaN for the others."""
        self.fires, given = fires.astype(np.float64), ~np.isnan(anchors)
        self._estimate(self.fires[given], anchors[given])
        self.posterior = self._classes()
        for _ in range(rounds):
            before = self.posterior
            self._estimate(self.fires, np.where(given, anchors, before))
            self.posterior = self._classes()
            if np.abs(before - self.posterior).max(initial=0) < 1e-6:
                break

    def _estimate(self, x: np.ndarray, posterior: np.ndarray) -> None:
        voters = x.shape[1]
        self.prior, self.rates, self.given = np.zeros(2), np.zeros((2, voters)), np.zeros((2, 2, voters, voters))
        information = np.zeros((voters, voters))
        for c, q in enumerate((1 - posterior, posterior)):
            total = q.sum() + 1.0
            one = q @ x
            both = (x * q[:, None]).T @ x
            self.prior[c] = total / (len(x) + 2)
            self.rates[c] = (one + 0.5) / total
            for b, (joint, margin) in enumerate(((one[None, :] - both, q.sum() - one), (both, one))):
                # rate of the column's voter where the row's voter is silent (0) or fires (1)
                self.given[c, b] = (joint + self.rates[c][None, :]) / (margin[:, None] + 1.0)
                p_row = (1 - self.rates[c], self.rates[c])[b]
                for fired in (0, 1):
                    p = self.given[c, b] if fired else 1 - self.given[c, b]
                    p_col = self.rates[c] if fired else 1 - self.rates[c]
                    information += self.prior[c] * p_row[:, None] * p * np.log(np.maximum(p, 1e-9) / np.maximum(p_col[None, :], 1e-9))
        self.parent = _spanning_tree(information + information.T)

    def _classes(self) -> np.ndarray:
        """P(toxic) of each document."""
        x, log = self.fires, []
        for c in (0, 1):
            z = np.full(len(x), np.log(self.prior[c]))
            for j, parent in enumerate(self.parent):
                p = np.full(len(x), self.rates[c, j]) if parent < 0 else np.where(x[:, parent] > 0, self.given[c, 1, parent, j], self.given[c, 0, parent, j])
                p = np.clip(p, 1e-6, 1 - 1e-6)
                z += np.where(x[:, j] > 0, np.log(p), np.log(1 - p))
            log.append(z)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def anchors_of(ids: list[int], label: list[int]) -> np.ndarray:
    """Labels of the half of the ids that the label model may know; of all, if that half lacks a class."""
    label, known = np.array(label, np.float64), np.array([zlib.crc32(f"anchor:{i}".encode()) % 2 == 0 for i in ids])
    return np.where(known, label, np.nan) if len(set(label[known])) == 2 else label


def _spanning_tree(weight: np.ndarray) -> list[int]:
    """Parent of each node (-1 for the first) in the spanning tree of the largest weights."""
    n = len(weight)
    parent, best, near, free = [-1] * n, np.full(n, -np.inf), np.zeros(n, int), np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        free[now] = False
        closer = free & (weight[now] > best)
        best[closer], near[closer] = weight[now][closer], now
        now = int(np.where(free, best, -np.inf).argmax())
        parent[now] = int(near[now])
    return parent


def feature_counts(sample: DataFrame, posterior) -> DataFrame:
    """(feature, pos, n): posterior-weighted and plain numbers of sampled documents that hold a feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            f = Features(part.column(1), **SPEC)
            own = [features_of(f.text(i)) for i in range(part.num_rows)]
            q = np.array([posterior.value[i] for i in part.column(0).to_pylist()])
            ids, at = np.unique(np.concatenate(own), return_inverse=True)
            size = np.array([len(o) for o in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.bincount(at, np.repeat(q, size), len(ids))), pa.array(np.bincount(at, minlength=len(ids)).astype(np.float64))],
                                             names=["feature", "pos", "n"])

    return sample.select("doc_id", "text").mapInArrow(run, "feature long, pos double, n double").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def presence(sample: DataFrame, chosen) -> DataFrame:
    """(doc_id, held): numbers of the chosen features (sorted) that each text holds, FEATURES at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            f = Features(part.column(1), **SPEC)
            held = [held_features(f.text(i), chosen.value).astype("<i4").tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary())], names=["doc_id", "held"])

    return sample.select("doc_id", "text").mapInArrow(run, "doc_id long, held binary")


def features_of(ids: np.ndarray) -> np.ndarray:
    """Features of a text from its hashes: twice the hash, and one more if it comes up OFTEN."""
    ids, n = np.unique(ids, return_counts=True)
    ids = ids.astype(np.int64) * 2
    return np.r_[ids, ids[n >= OFTEN] + 1]


def held_features(ids: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Numbers of the chosen features that a text with these hashes holds."""
    if not len(chosen) or not len(ids):
        return np.zeros(0, np.int64)
    known = np.unique(chosen >> 1)
    own = features_of(ids[known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids])
    at = np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)
    return at[chosen[at] == own]


def fit(held: list[np.ndarray], target: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier of soft targets, by accelerated proximal gradient steps.

    The penalty on the weights' sizes leaves the features that texts hold only
    because they are long, or in one language, without a weight.
    """
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    col = np.concatenate(held) if len(row) else np.zeros(0, np.int64)
    weight = np.stack([(1 - target) / max((1 - target).sum(), 1e-3), target / max(target.sum(), 1e-3)]) / 2  # classes count alike
    step = 4 / (1 + (weight.sum(axis=0)[row]).sum())
    w = before = np.zeros(n_features + 1)  # the last is the bias
    for k in range(STEPS):
        y = w + k / (k + 3) * (w - before)
        z = np.bincount(row, y[col], len(held)) + y[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = p * weight[0] - (1 - p) * weight[1]
        down = np.r_[np.bincount(col, g[row], n_features), g.sum()]
        before, w = w, y - step * down
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step * PENALTY, 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, bias) of the classifier."""
    none = np.zeros(0, np.int64), np.zeros(0)
    spark = docs.sparkSession
    sample = saved(without_copies(saved(training_sample(docs, labels), "toxic-labelled")), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return *none, np.inf if 1 in sizes else -np.inf
    n_all = sum(sizes.values())
    entries = saved(entries_of(sample), "toxic-entries")
    rows = votes(sample, entries, lexicons(entries, sizes[1], n_all)).orderBy("doc_id").collect()  # PER_CLASS ids a class
    fires = (np.array([r["mask"] for r in rows])[:, None] >> np.arange(len(VOTERS))) & 1
    ids = [r["doc_id"] for r in rows]
    q = LabelModel(fires, anchors_of(ids, [r["label"] for r in rows])).posterior
    counts = feature_counts(sample, spark.sparkContext.broadcast(dict(zip(ids, q.tolist()))))
    g = ratio(F.col("pos"), F.col("n"), F.lit(float(q.sum())), F.lit(float(n_all)))
    known = (F.greatest("pos", F.col("n") - F.col("pos")) >= SUPPORT) & apart(F.col("pos"), F.col("n"), float(q.sum()), n_all)
    best = counts.where(known).withColumn("g", g).where(F.col("g") >= LEAST_RATIO)
    chosen = np.array(sorted(r["feature"] for r in best.orderBy(F.desc("g"), "feature").limit(FEATURES).collect()), np.int64)
    held = {r["doc_id"]: np.frombuffer(bytes(r["held"]), "<i4") for r in presence(sample, spark.sparkContext.broadcast(chosen)).collect()}
    return chosen, *fit([held[i] for i in ids], q, len(chosen))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every whole text; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, b = shared.value
        for part in slices(batches, 1):
            f = Features(part.column(1), **SPEC)
            z = np.array([w[held_features(f.text(i), chosen)].sum() + b for i in range(part.num_rows)])
            score = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))  # none was labelled toxic
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from labelled documents outside the held-out fold."""
    return score_documents(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
