"""I-Match fingerprints over randomised lexicon subsets. DataFrame functions only.

A text's terms are its distinct lower-cased stretches of letters, digits and
non-ASCII characters. The lexicon holds the terms whose inverse document
frequency ln(N / df), over all documents, lies in ``IDF_BAND``: neither words
that every text has nor words that hardly any has.

Subsets: the lexicon is split at random (by the term's hash) into ``SLOTS``
disjoint subsets; within each, further subsets keep a quarter, a sixteenth and
a sixty-fourth of it. For each of these SLOTS * LEVELS subsets, the text's terms in
the subset are sorted and hashed together. Short texts are told apart by the
full subsets, long ones by the sparse ones, where a subset holds one or two
of the text's terms and so survives an edit that changes others.

A fingerprint is the list of these hashes as text, ``WIDTH`` characters each
(dots where the text has no term in the subset). The likeness of two
fingerprints is the share of equal hashes among the subsets that either text
has terms in, at the level where that share is largest (levels with fewer than
``ENOUGH`` such subsets don't count, but for the full one). A text without any
lexicon term has the hash of the whole text, like only to itself.

Scale: the band bounds the lexicon: at most (terms in a text, on average) /
e^-IDF_BAND[1] terms however many documents there are. It is broadcast only if it
has ``LEXICON_MAX`` terms or fewer, and joined by shuffle beyond. Terms of a
text meet the lexicon and their groups in the partition of the text; texts are
shuffled once, by document, to meet the next document's head.

Defined cases: a null text is the empty text; rows equal in id and text are one
document and give equal rows; rows that share an id but not the text follow one
another in order of their hash; null ids come first; the only document is its
own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved, shuffle_parts

#: ln 5 (a fifth of all documents) to ln 2000.
IDF_BAND = (1.6094, 7.6009)
SLOTS, LEVELS, WIDTH, ENOUGH = 16, 4, 4, 8
LEXICON_MAX = 2_000_000
#: ASCII characters that end a term: all but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
EMPTY = "." * WIDTH


def term_hashes(text: Column) -> Column:
    """Distinct 62-bit hashes of a text's terms (the two low bits are left free)."""
    split = F.split(F.lower(text), BREAK)
    hashed = F.transform(split, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-4)))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")).bitwiseAND(F.lit(-4)))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, df): the terms within the band, df counted over all rows of ``docs``."""
    # explode_outer: for explode, Spark would infer a filter that hashes the terms a second time
    terms = docs.select(F.explode_outer(term_hashes(F.coalesce("text", F.lit("")))).alias("term")).where("term is not null")
    total = docs.count()  # from the files' footers
    least, most = total * 2.718281828459045 ** -IDF_BAND[1], total * 2.718281828459045 ** -IDF_BAND[0]
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(F.lit(least), F.lit(max(most, 1.0))))


def _keys(docs: DataFrame) -> list[Column]:
    """A document's key: 64 bits of id and text, and the id."""
    return [F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("key_id")]


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, key, key_id, n_chars, copies, next_key, next_key_id) in ascending order of id, the last followed by the first.

    Rows are range-partitioned by id; each partition looks one row ahead, and a
    table of one row a partition gives its last row's successor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(docs), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    ranged = saved(rows.repartitionByRange(shuffle_parts(spark), "doc_id", "key").withColumn("stretch", F.spark_partition_id()), "order")
    heads = ranged.groupBy("stretch").agg(F.min(F.struct("doc_id", "key", "key_id")).alias("head"))
    by_stretch = Window.orderBy("stretch")  # over one row a partition
    every = Window.partitionBy()
    heads = heads.select("stretch", F.coalesce(F.lead("head").over(by_stretch), F.min("head").over(every)).alias("after"))
    ahead = Window.partitionBy("stretch").orderBy("doc_id", "key")
    return ranged.withColumn("ahead", F.lead(F.struct("doc_id", "key", "key_id")).over(ahead)).join(F.broadcast(heads), "stretch").select(
        "doc_id", "key", "key_id", "n_chars", "copies", F.coalesce("ahead.key", "after.key").alias("next_key"), F.coalesce("ahead.key_id", "after.key_id").alias("next_key_id"))


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(key, key_id, text, edited): the last quarter of each text replaced by the head of its successor's."""
    # one of the rows that are equal in id and text; the join needs this order anyway
    before = F.lag("key").over(Window.partitionBy("key", "key_id").orderBy("key"))
    texts = docs.select(*_keys(docs), F.coalesce("text", F.lit("")).alias("text")).withColumn("before", before).where("before is null").drop("before")
    takes = order.select(F.col("key").alias("of_key"), F.col("key_id").alias("of_key_id"), F.col("next_key").alias("key"),
                         F.col("next_key_id").alias("key_id"), F.floor(F.col("n_chars") / 4).cast("int").alias("take"))
    heads = takes.join(texts, ["key", "key_id"]).select(
        F.col("of_key").alias("key"), F.col("of_key_id").alias("key_id"), "take", F.col("text").substr(F.lit(1), F.col("take")).alias("head"))
    return texts.join(heads, ["key", "key_id"]).select(
        "key", "key_id", "text", F.concat(F.col("text").substr(F.lit(1), F.length("text") - F.col("take")), "head").alias("edited"))


def _subset_hash(terms: Column, level: int) -> Column:
    """WIDTH characters of the hash of a slot's sorted terms at a level."""
    kept = F.filter(terms, lambda x: x.bitwiseAND(F.lit((4 ** level - 1) << 6)) == 0) if level else terms
    packed = F.base64(F.unhex(F.lpad(F.hex(F.xxhash64(kept).bitwiseAND(F.lit(0xFFFFFF))), 6, "0")))
    return F.when(F.size(kept) > 0, packed).otherwise(F.lit(EMPTY))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    best = []
    for level in range(LEVELS):
        at = F.sequence(F.lit(level * SLOTS), F.lit(level * SLOTS + SLOTS - 1))
        part = lambda f, i: F.substring(f, i * WIDTH + 1, F.lit(WIDTH))
        used = F.size(F.filter(at, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY)))
        same = F.size(F.filter(at, lambda i: (part(a, i) != EMPTY) & (part(a, i) == part(b, i))))
        best.append(F.when(used >= (ENOUGH if level else 1), same / used))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) != F.length(b)) | (F.length(a) != SLOTS * LEVELS * WIDTH), F.lit(0.0)).otherwise(
        F.coalesce(F.greatest(*best), F.lit(0.0)))


def fingerprints(texts: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """(key, key_id, f_<column> ...): the fingerprints of two text columns; no row if neither has a lexicon term."""
    small = words.count() <= LEXICON_MAX
    entries = F.broadcast(words.select("term")) if small else words.select("term")
    one, two = columns
    both = texts.select("key", "key_id", term_hashes(F.col(one)).alias("one"), term_hashes(F.col(two)).alias("two"))
    # the low bits say which of the texts has the term
    tag = lambda terms, n: F.transform(terms, lambda x: x.bitwiseOR(F.lit(n)))
    tagged = F.concat(tag(F.array_intersect("one", "two"), 3), tag(F.array_except("one", "two"), 1), tag(F.array_except("two", "one"), 2))
    rows = both.select("key", "key_id", F.explode_outer(tagged).alias("tagged")).withColumn("term", F.col("tagged").bitwiseAND(F.lit(-4))).join(entries, "term")
    slot = F.shiftright("term", 2).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    has = lambda n: F.when(F.col("tagged").bitwiseAND(F.lit(n)) > 0, F.col("term"))
    slots = rows.groupBy("key", "key_id", slot.alias("slot")).agg(F.sort_array(F.collect_list(has(1))).alias("one"), F.sort_array(F.collect_list(has(2))).alias("two"))
    hashed = slots.select("key", "key_id", "slot", *[F.array(*[_subset_hash(F.col(c), n) for n in range(LEVELS)]).alias(c) for c in ("one", "two")])
    by_doc = hashed.groupBy("key", "key_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("one", "two")))).alias("slots"))

    def text(c: str) -> Column:
        levels = [F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: F.coalesce(F.get(F.col("slots")[j][c], F.lit(n)), F.lit(EMPTY))), "")
                  for n in range(LEVELS)]
        return F.concat(*levels)

    return by_doc.select("key", "key_id", text("one").alias(f"f_{one}"), text("two").alias(f"f_{two}"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next."""
    docs = docs.select("doc_id", "text")
    words = saved(lexicon(docs), "lexicon")
    order = successors(docs)
    texts = edited_texts(docs, order)
    whole = lambda c: F.concat(F.lit("text:"), F.hex(F.xxhash64(c)))
    found = fingerprints(texts, words, ["text", "edited"])
    blank = EMPTY * SLOTS * LEVELS
    base = texts.select("key", "key_id", F.sha2(F.col("edited"), 256).alias("edited_sha256"), whole("text").alias("whole"), whole("edited").alias("edited_whole"))
    pick = lambda f, w: F.when(F.coalesce(F.col(f), F.lit(blank)) == blank, F.col(w)).otherwise(F.col(f))
    joined = base.join(found, ["key", "key_id"], "left").select(
        "key", "key_id", "edited_sha256", pick("f_text", "whole").alias("fingerprint"), pick("f_edited", "edited_whole").alias("edited_fingerprint"))
    prints = saved(joined, "prints")
    after = prints.select(F.col("key").alias("next_key"), F.col("key_id").alias("next_key_id"), F.col("fingerprint").alias("next_fingerprint"))
    own = prints.join(order, ["key", "key_id"]).join(after, ["next_key", "next_key_id"]).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return own.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
