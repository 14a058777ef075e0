"""Ranked search and hard negatives against brute force."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, awkward_rows, empty, prose

from tessera.llm import negatives, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def ranked(rows, items, k):
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for i, c, n in docs:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "One two w1 w2 w3"), (2, "é Ω 漢字 and line"), (3, None), (4, "..."), (5, "w5 " * 50 + " x"), (1, "w7"), (1, "w7"), (None, "w8 NAÏVE l'été"), (6, "absent"), (7, prose(random.Random(2), 300))]


def run(spark, docs, items, **how):
    made = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in search.rank_documents(docs, made, **how).collect()), key=repr)


def test_search_of_awkward_rows(spark):
    expected = ranked([(r[0], r[1]) for r in awkward_rows()], ITEMS, 5)
    assert run(spark, awkward(spark), ITEMS, k=5) == expected
    # items in several passes
    assert run(spark, awkward(spark), ITEMS, k=5, terms=4) == expected


def test_search_in_many_blocks_with_ties(spark, monkeypatch):
    for name, value in (("POSTINGS", 300), ("DOCS", 16), ("LEAF", 4), ("WAVE", 2)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 40), 60) for _ in range(300)]
    rows = [(i, rng.choice(texts[:40]) if i % 3 else t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = [(k, prose(rng, rng.randrange(1, 15), 60)) for k in range(12)]
    expected = ranked([r[:2] for r in rows], items, 7)
    assert run(spark, docs.coalesce(1), items, k=7) == expected
    # workers of other tasks have the plain bounds
    monkeypatch.undo()
    assert run(spark, docs, items, k=7) == expected


def test_blocks_and_bounds_without_spark():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 200)
    most = search.RangeMaximum(values, 200)
    lo = rng.integers(0, 199, 500)
    hi = np.array([rng.integers(a + 1, 201) for a in lo])
    at = most(lo, hi)
    assert all(a <= p < z and values[p] == values[a:z].max() for a, z, p in zip(lo, hi, at))
    n, seen = 120, {}
    rows = sorted((int(t), int(d)) for t in range(9) for d in rng.choice(n, rng.integers(1, n), replace=False))
    tf = rng.integers(1, 4, len(rows))
    terms_, sizes = np.unique([t for t, _ in rows], return_counts=True)
    row = {"ids": np.arange(n, dtype="<i8").tobytes(), "nulls": np.zeros(n, np.uint8).tobytes(), "lengths": rng.integers(5, 90, n).astype("<i8").tobytes(),
           "terms": (terms_ + 3).astype("<i4").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "docs": np.array([d for _, d in rows], "<u2").tobytes(), "counts": tf.astype("<u4").tobytes()}
    weights = rng.integers(0, 9000, 20)
    block = search.Block(row, weights, 500, 20000)
    for k, (_, d) in enumerate(rows):
        seen.setdefault(d, {})[rows[k][0] + 3] = int(block.impact[k])
    for wanted in ([3, 4, 5], [0, 2, 11, 15], [1], list(range(20))):
        for leaf, wave in ((2048, 32), (1, 1), (7, 3)):
            search.LEAF, search.WAVE, kept = leaf, wave, (search.LEAF, search.WAVE)
            try:
                best = search.Best(10)
                block.search(np.array(wanted), best)
            finally:
                search.LEAF, search.WAVE = kept
            sums = sorted(((-sum(v for t, v in s.items() if t in wanted), d) for d, s in seen.items()))
            assert list(zip((-best.scores).tolist(), best.ids.tolist())) == [x for x in sums if x[0] < 0][:10]


def test_search_of_nothing(spark):
    assert run(spark, empty(spark), ITEMS) == []
    assert run(spark, awkward(spark), []) == []
    assert run(spark, awkward(spark), [(1, None), (2, "!")]) == []


# ------------------------------------------------------------ hard negatives

VECTORS = "id long, label int, vector array<float>"


def mined(rows, positives=5, k=5, low=80, high=100):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a in {(i, y, tuple(v)) for i, y, v in kept if i is not None and i % 100 == 0}:
        others = [(dot(a[2], v), i, y) for i, y, v in kept if (i, y, tuple(v)) != a]
        for p in sorted((r for r in others if r[2] == a[1]), key=order)[:positives]:
            near = sorted((r for r in others if r[2] != a[1] and low * p[0] <= 100 * r[0] <= high * p[0]), key=order)[:k]
            out += [(a[0], p[1], n + 1, r[1], p[0], r[0]) for n, r in enumerate(near)]
    return sorted(out, key=repr)


def mine(spark, rows, **how):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("s")).withColumn("key", F.lit(1)).withColumn("mark", F.lit(2))
    return sorted((tuple(r) for r in negatives.mine(df, F.col("id") % 100 == 0, **how).collect()), key=repr)


def vectors(n, dim, rng, step=8):
    return [(k, rng.randrange(3), [rng.randrange(-step, step + 1) / step for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("block, chunk", [(4096, 1024), (37, 2)])
def test_negatives_against_brute_force(spark, block, chunk):
    rows = vectors(420, 4, random.Random(6))  # few values: many ties
    assert mine(spark, rows, block=block, chunk=chunk) == mined(rows)


def test_negatives_of_awkward_rows(spark):
    rows = vectors(150, 3, random.Random(9), 4)
    rows += [(None, 1, [1.0, 0.5, 0.25]), (None, 2, [1.0, 0.5, 0.25]), (500, None, [1.0] * 3), (501, 1, None), (502, 1, [1.0, None, 1.0]), (503, 2, [1.0, float("nan"), 0.0]),
             (504, 2, [float("inf"), 0.0, 0.0]), (600, 0, []), (601, 1, [0.5]), (602, 1, [0.5] * 7), rows[0], rows[100], rows[5], (0, 2, [0.25, 0.5, 1.0]), (700, 9, [1.0, 1.0, 1.0])]
    assert mine(spark, rows) == mined(rows)
    big = [(100 * k, k % 2, [2.0**19 * (1 + k / 8), -(2.0**18), 3.0]) for k in range(8)]  # products beyond 2**53
    assert mine(spark, big) == mined(big)
    assert mine(spark, []) == [] and mine(spark, [(100, 1, [1.0])]) == []


def test_windows_hold_only_what_is_open():
    keys = sorted([negatives.key_of(7, 1, 100, 0, 0, 3), negatives.key_of(7, 1, 90, 0, 0, 4)] + [negatives.key_of(7, 1, s, 1, 0, s) for s in (-5, 70, 75, 80, 90, 95, 100, 120)])
    assert list(negatives.windows_of(iter(keys), 2, 80, 100)) == [
        (7, 3, 1, 100, 100, 100), (7, 3, 2, 95, 100, 95), (7, 4, 1, 90, 90, 90), (7, 4, 2, 80, 90, 80)]
