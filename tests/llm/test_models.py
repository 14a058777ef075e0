"""Held-out accuracy and edge cases of the trained operators."""
import zlib

from helpers import awkward, awkward_rows, empty

from tessera.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


def in_fold(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(r["held_out"] == in_fold(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    tested = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) / len(tested) > 0.95
    learned = {r["doc_id"] for r in quality.training_sample(labels).collect()}
    assert learned and not any(map(in_fold, learned))


def test_quality_edge_cases(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 0, 0), (12, 0, None), (None, 1, 0), (14, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in out)
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = language.identify(docs).collect()
    assert len(out) == len(truth) and all(r["held_out"] == in_fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    tested = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) / len(tested) > 0.97
    assert not any(in_fold(r["doc_id"]) for r in language.training_sample(docs).collect())


def test_language_edge_cases(spark):
    rows = {(r["doc_id"], r["lang_pred"]) for r in language.identify(awkward(spark)).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (16, "und")} <= rows
    langs = {"en", "fr", "de", "es"}
    assert all(p in langs for i, p in rows if i not in (4, 5, 6, 16))
    assert language.identify(empty(spark)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", language.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    one = awkward(spark).where("lang = 'en'")
    assert {r["lang_pred"] for r in language.identify(one).collect()} <= {"en", "und"}


def test_votes_within_the_family():
    import numpy as np
    model = {"langs": ["de", "en", "es", "fr"], "families": ["germanic", "romance"], "pairs": [(0, 1), (2, 3)]}
    names, scores = language.decide(model, np.array([[3.0, 0, -1, 5], [0, 3.0, 5, -1]], float))
    assert names == ["en", "fr"] and (0 < scores).all() and (scores < 1).all()


def test_toxicity_on_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(r["held_out"] == in_fold(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    tested = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = ([r["predicted"] for r in tested if truth[r["doc_id"]] == y] for y in (1, 0))
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02
    assert not any(in_fold(r["doc_id"]) for r in toxicity.training_sample(docs, labels).collect())


def test_toxicity_edge_cases(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (10, 0, 1), (12, 0, None), (None, 1, 0), (14, None, 1), (1, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert 14 not in {r["doc_id"] for r in toxicity.training_sample(docs, labels).collect()}  # labelled both ways
    assert {r["score"] for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.0}
    assert {r["predicted"] for r in toxicity.classify(docs, labels.where("toxic = 1")).collect()} <= {0, 1}
    assert toxicity.classify(empty(spark), labels).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    import numpy as np
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    rates = [(0.02, 0.8), (0.1, 0.6), (0.3, 0.3), (0.05, 0.7)]
    fires = np.stack([np.where(y, rng.random(3000) < b, rng.random(3000) < a) for a, b in rates], 1)
    fires = np.c_[fires, fires[:, 1] ^ (rng.random(3000) < 0.02)]  # nearly repeats voter 1
    anchors = np.where(np.arange(3000) < 300, y.astype(float), np.nan)
    m = toxicity.LabelModel(fires, anchors)
    assert np.abs(m.rates[:, :4].T - rates).max() < 0.06 and abs(m.prior[1] - 0.3) < 0.05
    assert m.parent[4] == 1 or m.parent[1] == 4
    assert ((m.posterior > 0.5) == y).mean() > 0.93
    # the repeat adds nothing: a tree trusts both together hardly more than one
    plain = toxicity.LabelModel(fires[:, :4], anchors)
    assert np.abs(m.posterior - plain.posterior).mean() < 0.02


def test_toxic_copies_are_learned_once(spark):
    import random

    from helpers import prose
    rng = random.Random(1)
    text = prose(rng, 200)
    rows = [(k, 1, text + f" end{k}") for k in range(20)] + [(k, 0, prose(rng, 100)) for k in range(100, 105)] + [(200, 0, text), (201, 1, ""), (202, 1, " ")]
    left = {r["doc_id"] for r in toxicity.without_copies(spark.createDataFrame(rows, "doc_id long, label int, text string")).collect()}
    assert left == {0, 100, 101, 102, 103, 104, 200, 201, 202}


def test_rows_that_share_an_id_keep_their_own_language(spark):
    rows = [(1, "the same words again", "en", "a", 1), (1, "und noch ein Satz", "de", "a", 1), (1, "nothing known", None, "a", 1), (2, "another text of it", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").where("doc_id < 3")
    found = language.sampled_features(docs, language.training_sample(docs), "lang", **language.SPEC)
    kept = [r for r in rows if r[2] and not in_fold(r[0])]
    assert sorted(f[0] for f in found) == sorted(r[2] for r in kept)
    sizes = {(f[0], int(f[2].sum())) for f in found}
    grams = lambda t: sum(max(0, len(t.encode()) - n + 1) for n in language.GRAMS)
    assert sizes == {(r[2], grams(r[1])) for r in kept}


def test_quality_ignores_ids_labelled_both_ways(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    got = {tuple(r) for r in quality.training_sample(labels).collect()}
    assert got == {(i, y) for i, y in ((2, 1), (3, 0)) if not in_fold(i)}


def test_families_of_regional_codes():
    assert [language.family(x) for x in ("EN", "pt-BR", "zh_TW", "fr")] == ["germanic", "romance", "zh", "romance"]
