"""Quality rules, with verdicts on hosts. DataFrame functions only.

Every document gets counts over its whole text and fails the base rules when it
has fewer than ``MIN_WORDS`` words or more than half of its words lie in
three-word windows that occur twice or more in it. Failures of four rules
(short, repetitive, symbols, repeated lines) are summed by host; a host's rate
for a rule is shrunk towards the corpus by a beta prior fitted to all hosts by
moments, so that a host with few documents is judged mostly by the corpus. A
host is rejected when a shrunk rate reaches ``HOST_LIMIT``; the verdict is
joined back to its documents.

Windows are compared within the row: the hashes of a text's windows are sorted
with their positions, so a text of n words costs O(n log n) and no word leaves
its row. Equal windows are recognised by 64-bit hashes within one text.

Hot hosts: rows are summed map-side; the join back carries the counts only
(not the text), and its large partitions can be split, since a host has one row
on the other side. The prior is one row of sums, of fixed size.

Defined cases: a null text has no words and fails; a null source is no host, and
its documents are judged by the base rules alone; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import SPACE, saved, words

MIN_WORDS = 50
#: A host is rejected when a shrunk failure rate is at least this.
HOST_LIMIT = 0.8
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0
SYMBOLS = "#*$%&|<>"
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["short", "repetitive", "symbols", "repeated_lines"]


def _repeat_words(placed: Column) -> Column:
    """Words covered by windows that occur at least twice.

    ``placed``: the windows as (hash, position) in sorted order.
    """
    twin = lambda e, i: ((i > 0) & (F.get(placed, i - 1)["h"] == e["h"])) | ((i < F.size(placed) - 1) & (F.get(placed, i + 1)["h"] == e["h"]))
    found = F.sort_array(F.transform(F.filter(placed, twin), lambda e: e["at"]))
    # a window adds the words by which it lies beyond the one before, three at most
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    step = lambda acc, at: F.struct(at.alias("at"), (acc["n"] + F.least(F.lit(3), at - acc["at"])).alias("n"))
    return F.aggregate(found, start, step, lambda acc: acc["n"])


def text_facts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns FACTS (long) and base_failed; clashing columns are replaced."""
    keep = [c for c in docs.columns if c not in [*FACTS, "base_failed"]]
    kept = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    step = docs.select(*kept, text.alias("fact text"), words(F.col("text")).alias("fact words"), lines.alias("fact lines"))
    w = F.col("fact words")
    hashes = F.when(F.size(w) >= 3, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)).otherwise(
        F.array().cast("array<long>"))
    step = step.select(
        *kept, F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("fact text") - F.length(F.translate("fact text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("fact lines") - F.size(F.array_distinct("fact lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("fact windows"))
    h = F.col("fact windows")
    # most texts repeat no window: their windows are not sorted
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))))
    step = step.select(*kept, *FACTS[:4], placed.alias("fact placed"))
    repeat = F.when(F.col("fact placed").isNull(), F.lit(0)).otherwise(_repeat_words(F.col("fact placed")))
    step = step.select(*kept, *FACTS[:4], repeat.cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def _rule_failures() -> list[Column]:
    return [F.col("n_words") < MIN_WORDS, 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
            10 * F.col("n_symbols") > F.col("word_chars"), 4 * F.col("n_dup_lines") > F.col("n_words")]


def host_verdicts(facts: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: its documents, failures and shrunk rates by rule, and whether it is rejected."""
    hosts = saved(facts.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(x.cast("long")).alias(f"{r}_failed") for r, x in zip(RULES, _rule_failures())]), "hosts")
    sums = hosts.agg(F.sum("host_docs").alias("n"), *[F.sum(f"{r}_failed").alias(f"{r}_f") for r in RULES],
                     *[F.sum(F.col(f"{r}_failed") * F.col(f"{r}_failed") / F.col("host_docs")).alias(f"{r}_q") for r in RULES]).first()
    rates = []
    for r in RULES:
        n = sums["n"] or 1
        mean = (sums[f"{r}_f"] or 0) / n
        spread = max((sums[f"{r}_q"] or 0) / n - mean * mean, 1e-12)  # variance between hosts
        strength = min(max(mean * (1 - mean) / spread - 1, PRIOR_MIN), PRIOR_MAX)
        rates.append(F.round((F.col(f"{r}_failed") + mean * strength) / (F.col("host_docs") + strength), 9).alias(f"{r}_rate"))
    rejected = F.greatest(*[F.col(f"{r}_rate") for r in RULES]) >= HOST_LIMIT
    return hosts.select("*", *rates).withColumn("host_rejected", rejected)


def judge(docs: DataFrame, host: str = "source", with_facts: bool = True) -> DataFrame:
    """Small rows: the columns of ``docs`` except the text, FACTS, base_failed and kept."""
    # written before anything filters on it: a filter pushed into the projections
    # would evaluate a text's words anew for each of them
    facts = saved(text_facts(docs).drop("text", "kept"), "facts")
    verdicts = host_verdicts(facts, host).where("host_rejected").select(F.col("host").alias("rejected host"))
    out = facts.join(verdicts, F.col(f"`{host}`") == F.col("rejected host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected host").isNull()).drop("rejected host")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host is not rejected.

    The text is read twice, for the hosts' sums and for the rows, and never
    shuffled: only the table of rejected hosts meets the rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept row")
    facts = text_facts(docs.select(row, "text", F.col(f"`{host}`").alias("fact host")))
    rejected = host_verdicts(facts.select("fact host", *FACTS), "fact host").where("host_rejected").select(F.col("host").alias("rejected host"))
    # one row or none: a plain filter would be pushed into the projections below
    # and evaluate a text's words anew for each of them
    passes = F.explode_outer(F.when(~F.col("base_failed"), F.array(F.lit(1)))).alias("passes")
    good = facts.select("kept row", "fact host", passes).where("passes is not null")
    return good.join(rejected, F.col("fact host") == F.col("rejected host"), "left_anti").select("kept row.*")
