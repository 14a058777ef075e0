"""Near duplicates, repeated passages and fingerprints against brute force."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, awkward, awkward_rows, component_ids, empty, prose, words

from tessera.llm import imatch, jaccard, suffixes
from tessera.llm.vectors import Words

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    return frozenset([tuple(w[k:k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def plain_components(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = component_ids(links, range(len(rows)))
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[j][0] for j in of if of[j] == of[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return out


def near_copies(rng, n, edits):
    base = prose(rng, 120, 3000).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
        out.append(" ".join(own))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 6)  # so that a small table has frequent shingles
    monkeypatch.setattr(jaccard, "BLOCK", 2000)  # and units of several blocks
    rng = random.Random(2)
    shared = prose(rng, 60, 9000)
    texts = [t for n, e in ((40, 1), (12, 3), (3, 2), (2, 5)) for t in near_copies(rng, n, e)]
    texts += [prose(rng, rng.randrange(1, 90)) + " " + shared for _ in range(25)] + [shared] * 3 + [shared + " tail", "a b c", "A b C", "a b"]
    rows = [(100 + k, t, "en", "a", 1) for k, t in enumerate(texts)] + awkward_rows()
    rng.shuffle(rows)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert order([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out]) == order(plain_components(rows))


def test_components_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = jaccard.near_duplicates(docs).collect()
    assert order([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out]) == order(plain_components(rows))


def test_frequent_shingles_beyond_the_list_are_stars(spark, monkeypatch):
    # 2,000 sets that share a shingle which isn't on the list, and two that share another one
    n = 2000
    token = np.r_[np.full(n, 5), 6, 6].astype(np.uint64)
    sid = np.r_[np.arange(n), 7, 9].astype(np.uint64)
    blob = token.tobytes() + sid.tobytes() + np.full(n + 2, 10, np.uint32).tobytes() + np.zeros(n + 2, np.uint32).tobytes()
    met = jaccard._meet(pa.table({"blob": pa.array([blob], pa.binary())})).to_pylist()
    assert len(met) == n  # n - 1 spokes and the counted pair
    assert len(set(component_ids([(r["a"], r["b"]) for r in met], range(n)).values())) == 1
    assert [(r["a"], r["b"], r["shared"]) for r in met if r["shared"]] == [(7, 9, 1)]
    # no list at all: the groups that would be on it still give the same components
    monkeypatch.setattr(jaccard, "LIST_MAX", 0)
    rng = random.Random(12)
    texts = [t for copies, edits in ((150, 4), (5, 2)) for t in near_copies(rng, copies, edits)] + [prose(rng, 90) for _ in range(5)]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    assert not len(jaccard.global_order(spark.createDataFrame(rows, SCHEMA))[0])
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert order([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out]) == order(plain_components(rows))


def test_rows_with_null_ids_link_others(spark):
    rng = random.Random(21)
    base = prose(rng, 120, 3000).split()
    far = list(base)
    far[20:24] = "a b c d".split()
    further = list(far)
    further[90:94] = "p q r s".split()
    # a ~ n ~ b with a null id in the middle, but not a ~ b
    rows = [(1, " ".join(base), "en", "a", 1), (None, " ".join(far), "en", "a", 1), (2, " ".join(further), "en", "a", 1)]
    rows += [(None, " ".join(far), "en", "b", 1)] * 3 + [(None, prose(rng, 80), "en", "a", 1)]
    rows += [(None, t, "en", "a", 1) for t in near_copies(rng, 3, 2)] + [(9, prose(rng, 60), "en", "a", 1), (9, prose(rng, 70), "en", "a", 1)]
    a, n, b = (shingle_set(r[1]) for r in rows[:3])
    assert 100 * len(a & b) < 80 * len(a | b) and 100 * len(a & n) >= 80 * len(a | n) and 100 * len(b & n) >= 80 * len(b | n)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["component_id"] for r in out if r["doc_id"] == 2] == [1]
    assert order([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out]) == order(plain_components(rows))


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 7 in ids and 8 not in ids and None in ids and 4 in ids and 5 in ids
    assert jaccard.keep_one(empty(spark)).count() == 0


def test_one_row_of_each_group_stays_by_id_and_text(spark):
    rng = random.Random(31)
    own = prose(rng, 80)
    copies, nulls, more = near_copies(rng, 2, 1), near_copies(rng, 3, 1), near_copies(rng, 2, 1)
    rows = [(3, copies[0], "en", "a", 1), (17, copies[1], "en", "a", 1), (17, own, "en", "a", 1)]  # a shared id
    rows += [(None, t, "en", "a", 1) for t in nulls]  # near copies without an id
    rows += [(5, more[0], "fr", "b", 1), (5, more[0], "en", "b", 1), (5, more[0], "en", "b", 1), (6, more[1], "en", "b", 1)]  # repeated rows
    rows += [(8, "", "en", "c", 0), (9, None, "en", "c", 0), (9, None, "en", "c", 0), (None, " ", "en", "c", 1)]  # without words
    kept = order(tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    without_id = [r for r in kept if r[0] is None and r[1] != " "]
    assert len(without_id) == 1 and without_id[0][1] in nulls
    assert [r for r in kept if r not in without_id] == order(
        [(3, copies[0], "en", "a", 1), (5, more[0], "en", "b", 1), (17, own, "en", "a", 1), (8, "", "en", "c", 0), (9, None, "en", "c", 0), (None, " ", "en", "c", 1)])


def plain_repeats(rows):
    """Words covered by a 50-word window that occurs before, and by the first occurrence of such a window."""
    first, repeated, original = {}, {}, {}
    docs = {(i, t) for i, t, *_ in rows if t is not None}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        w = words(t)
        for s in range(len(w) - 49):
            at = first.setdefault(tuple(w[s:s + 50]), (i, s))
            if at != (i, s):
                repeated.setdefault(i, set()).update(range(s, s + 50))
                original.setdefault(at[0], set()).update(range(at[1], at[1] + 50))
    return repeated, original


@pytest.mark.parametrize("chunk", [200_000, 40, 7])
def test_repeats_equal_brute_force(spark, chunk):
    rng = random.Random(4)
    passages = [prose(rng, n, 9000) for n in (49, 50, 51, 80, 300)]
    rows = [(200 + k, f"{prose(rng, rng.randrange(40))} {p} {prose(rng, rng.randrange(40))}", "en", "a", 1) for k, p in enumerate(passages * 4)]
    rows += [r for r in awkward_rows() if r[0] != 17]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {True: {}, False: {}}
    for r in suffixes.repeated_passages(docs, chunk).collect():
        found[r["repeated"]].setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    repeated, original = plain_repeats(rows)
    assert found[True] == repeated and found[False] == original


def test_words_beside_a_shared_passage_are_compared_in_full(spark):
    # pairs of different words whose hashes agree in the first 16 bits, on either side of 49 shared words
    names = [f"n{k}" for k in range(3000)]
    codes, pairs = {}, []
    for name, h in zip(names, Words(pa.array(names)).hash):
        other = codes.setdefault(int(h) >> 48, name)
        if other != name:
            pairs.append((other, name))
    assert len(pairs) >= 4
    rng = random.Random(6)
    rows = []
    for k, (a, b) in enumerate(pairs[:4]):
        p = prose(rng, 49, 9000)
        rows += [(2 * k, f"{a} {p}" if k % 2 else f"{p} {a}", "en", "a", 1), (2 * k + 1, f"{b} {p}" if k % 2 else f"{p} {b}", "en", "a", 1)]
    assert plain_repeats(rows) == ({}, {})
    assert suffixes.repeated_passages(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_cutting_repeats(spark):
    rng = random.Random(8)
    p = prose(rng, 60, 9000)
    rows = [(1, f"start {p} close", "en", "a", 0), (2, f"other\n {p}\tend  here", "en", "a", 0), (3, p, "en", "a", 0), (4, None, "en", "a", 0), (5, "", "en", "a", 0)]
    out = {r["doc_id"]: r for r in suffixes.cut_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out.keys() == {1, 2, 4, 5}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "other\n end  here" and out[2]["n_chars"] == len("other\n end  here")
    assert out[4]["text"] is None and out[5]["text"] == ""
    docs = awkward(spark)
    assert suffixes.cut_repeats(docs).columns == docs.columns
    assert suffixes.cut_repeats(empty(spark)).count() == 0


def test_fingerprints(spark):
    rows = [r for r in awkward_rows() if r[0] != 17] + [(300 + k, prose(random.Random(k), 200, 3000), "en", "a", 1) for k in range(60)]
    out = imatch.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    docs = sorted({(i, t) for i, t, *_ in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    after = {d: docs[(k + 1) % len(docs)][1] or "" for k, d in enumerate(docs)}
    text = dict(docs)
    prints = {}
    for r in out:
        t, n = text[r["doc_id"]] or "", after[(r["doc_id"], text[r["doc_id"]])]
        cut = len(t) // 4
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    own = [r for r in out if (r["doc_id"] or 0) >= 300]
    assert sum(r["near_edited"] for r in own) / len(own) > 0.35 > 0.1 > sum(r["near_next"] for r in own) / len(own)
    assert imatch.compare_with_next(empty(spark)).count() == 0


def test_fingerprint_is_the_sorted_terms_of_the_band(spark):
    docs = spark.createDataFrame([(k, f"common t{k} t{k + 1} rare{k}", "en", "a", 1) for k in range(40)], SCHEMA)
    terms = {r["df"] for r in imatch.lexicon(docs).collect()}
    assert terms == {1, 2}  # "common" is outside the band
    a, b = spark.createDataFrame([(1, "t1 t2 t3", "", "", 1), (2, "t3  t2, T1 t1 common", "", "", 1)], SCHEMA).select("doc_id", "text").collect()
    pair = spark.createDataFrame([(1, 1, a["text"], b["text"])], "key long, key_id long, text string, edited string")
    r = imatch.fingerprints(pair, imatch.lexicon(docs), ["text", "edited"]).collect()[0]
    assert r["f_text"] == r["f_edited"] and len(r["f_text"]) == imatch.SLOTS * imatch.LEVELS * imatch.WIDTH


def test_size_classes_hold_all_that_can_be_linked():
    bounds = jaccard._BOUNDS
    for n in [*range(1, 400), 10**6, 123457]:
        far = 100 * n // jaccard.PERCENT  # the largest set that can be linked with one of n
        assert np.searchsorted(bounds, far, "right") - np.searchsorted(bounds, n, "right") <= 1
    for a, z in zip(bounds[:60], bounds[1:60]):
        assert 100 * a >= jaccard.PERCENT * (z - 1)
    token = np.array([5, 5, 5, 5, 7, 7, 7], np.uint64)
    assert jaccard._heads(token, np.array([10, 12, 16, 19, 10, 12, 15])).tolist() == [0, 0, 2, 2, 4, 4, 4]


def test_trie_links_join_what_brute_force_joins():
    rng = random.Random(12)
    base = [rng.sample(range(10**6), 40) for _ in range(6)]
    sets = {tuple(sorted(set(b[rng.randrange(0, 4):]) | set(rng.sample(range(10**6), rng.randrange(0, 6))))) for b in base for _ in range(30)}
    sets = [np.array(s, np.uint64) for s in sorted(sets)]
    nodes = range(len(sets))
    plain = component_ids([(i, j) for i in nodes for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))], nodes)
    links = jaccard.Trie(sets).links()
    assert component_ids(links, nodes) == plain and len(links) < len(sets)


def test_trie_passes_by_what_cannot_be_linked(monkeypatch):
    rng = np.random.default_rng(5)
    shared = np.arange(60, dtype=np.uint64) + np.uint64(1 << 40)
    own = [np.r_[np.unique(rng.integers(0, 1 << 39, 30, dtype=np.uint64)), shared] for _ in range(400)]  # alike in what all share only
    near = [np.unique(np.r_[np.delete(own[0], rng.choice(90, 4, replace=False)), rng.integers(0, 1 << 39, 3, dtype=np.uint64)]) for _ in range(400)]
    seen = []
    need = jaccard.need
    monkeypatch.setattr(jaccard, "need", lambda a, b: seen.append(a) or need(a, b))
    for sets, n_links in ((own, 0), (near, 399), (own + near, 400)):
        seen.clear()
        assert len(jaccard.Trie(sorted(sets, key=lambda s: s.astype(">u8").tobytes())).links()) == n_links
        assert len(seen) < 12 * len(sets)  # each probe looked at every branch before


def test_extension_to_both_sides_of_one_gram(spark):
    # a passage of 60 words with other words on either side at other distances: each pair agrees over another stretch
    rng = random.Random(17)
    p = prose(rng, 60, 9000).split()
    rows = []
    for k, (a, z) in enumerate([(0, 60), (5, 60), (0, 55), (9, 59), (10, 60), (11, 60), (4, 54), (0, 49), (3, 60), (0, 60)]):
        rows.append((k, " ".join([f"l{k}"] * k + p[a:z] + [f"r{k}"] * 3), "en", "a", 1))
    rng.shuffle(rows)
    repeated, original = plain_repeats(rows)
    for chunk in (1000, 3):
        found = {True: {}, False: {}}
        for r in suffixes.repeated_passages(spark.createDataFrame(rows, SCHEMA), chunk).collect():
            found[r["repeated"]].setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert found[True] == repeated and found[False] == original
