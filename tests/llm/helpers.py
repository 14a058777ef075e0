"""Tables with every awkward case, and plain versions of what operators compute."""
from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(3)
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(rng, 70, 5000)
    rows = [
        (1, base, "en", "a", 9), (2, base, "en", "a", 9), (2, base, "en", "a", 9), (3, " ".join(near), "fr", None, None),
        (4, None, None, "b", 0), (5, "", "de", "b", 0), (6, " \n\t ", "de", None, 3), (7, "one two", "en", "c", 7),
        (8, "One  TWO", "en", "c", 7), (None, prose(rng, 80), "en", "c", 1), (9, prose(rng, 20000), "es", "hot", 5),
        (10, "x" * 40000, "es", "hot", 5), (11, "é ü ñ Ω 漢字 " * 30, None, "hot", 5), (12, "and " * 3000, "en", "hot", 5),
        (13, "line\nline\nline again\n\nline", "en", "hot", 1), (14, prose(rng, 90) + " " + passage + " " + prose(rng, 10), "en", "hot", 1),
        (15, passage + " " + prose(rng, 120), "en", "hot", 1), (16, "#*$%&|<> 12 34", None, "d", 1), (17, prose(rng, 60), "fr", "d", 1),
        (17, prose(rng, 61), "fr", "d", 1), (-5, "'s it's 12345 l'été   naïve x \U0001F600!!", "fr", "d", 1)]
    return rows


def awkward(spark):
    """The rows as a table with extra columns whose names operators might use."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.withColumn("size", F.lit("s")).withColumn("key", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("kept", F.lit("k")).withColumn(
        "n_words", F.lit("n")).withColumn("cuts", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("target", F.lit("t")).withColumn("score", F.lit("q"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def component_ids(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
