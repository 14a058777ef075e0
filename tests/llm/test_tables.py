"""Sharding, mixing and quality rules."""
import random
import zlib

import pytest
from helpers import SCHEMA, awkward, awkward_rows, empty, words

from tessera.llm import mixing, rules, shards


def test_differencing_is_near_equal_and_keeps_every_weight_once():
    rng = random.Random(1)
    weights = [[rng.randrange(1, 1000)] + [0] * 7 for _ in range(300)]
    places, sums = shards.difference(weights, 8)
    again = [0] * 8
    for w, p in zip(weights, places):
        assert sorted(p) == list(range(8))
        for k in range(8):
            again[p[k]] += w[k]
    assert again == sums and max(sums) - min(sums) <= 5
    assert shards.difference([], 3) == ([], [0, 0, 0])


def test_shards_of_awkward_rows(spark):
    docs = awkward(spark)
    out = shards.shard_documents(docs, 4)
    assert {"doc_id", "key", "score", "size", "text_crc32", "shard", "slot"} <= set(out.columns)
    rows = out.collect()
    source = awkward_rows()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1) for i, t, *_ in source)
    assert {r["text_crc32"] for r in rows} == {None if t is None else zlib.crc32(t.encode()) for _, t, *_ in source}
    groups = {}
    for r in rows:
        groups.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    for k in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert shards.shard_documents(empty(spark)).count() == 0


def water(sizes, epochs=3):
    """Targets by clamping and sharing again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        rest = total - sum(epochs * sizes[s] for s in clamped)
        share = sum(weight[s] for s in free)
        target = {s: epochs * sizes[s] if s in clamped else rest * weight[s] / share for s in names}
        above = {s for s in free if target[s] > epochs * sizes[s]}
        if not above:
            return target
        clamped |= above


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "a", "b", "c", "é", None]), 0) for k in range(3000)]
    rows += [(5000 + k, "one two three", "en", "tiny", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["times"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    expected = water(sizes)
    taken = {}
    for r in plan:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["times"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["times"]
    assert all(abs(taken[s] - expected[s]) <= 60 for s in sizes)
    assert expected["tiny"] == 27 and taken["tiny"] == 27
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["times"] for r in plan)


def test_mix_of_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    plan = mixing.mix_plan(docs)
    assert plan.count() == docs.count() and {"key", "score", "times"} <= set(plan.columns)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def plain_facts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    repeated = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_facts_of_awkward_rows(spark):
    out = rules.judge(awkward(spark)).collect()
    found = sorted(tuple(r[c] for c in rules.FACTS) for r in out)
    assert found == sorted(plain_facts(t) for _, t, *_ in awkward_rows())
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert rules.judge(empty(spark)).count() == 0 and rules.keep_good(empty(spark)).count() == 0


def test_a_bad_host_takes_its_documents_with_it(spark):
    good = " ".join(f"w{k}" for k in range(100))
    rows = [(k, "short text", "en", "bad", 0) for k in range(200)] + [(1000 + k, f"{good} {k}", "en", "good", 0) for k in range(200)]
    rows += [(5000, good, "en", "bad", 0), (5001, good, "en", None, 0), (5002, "too short", "en", "new", 0), (5003, good, "en", "new", 0), (None, good, "en", "bad", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in rules.keep_good(docs).collect()}
    assert kept == {*range(1000, 1200), 5001, 5003}
    verdict = {r["host"]: r["host_rejected"] for r in rules.host_verdicts(rules.text_facts(docs)).collect()}
    assert verdict == {"bad": True, "good": False, "new": False}
    out = rules.keep_good(awkward(spark))
    assert out.columns == awkward(spark).columns
