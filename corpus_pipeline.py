"""A training-data pipeline over the table ``documents``.

Five stages, each over all that its predecessor kept: quality rules (rejected
documents go), near duplicates (one document of each group stays), repeated
passages (later occurrences are cut from the texts), mixing (documents are
repeated or left out until sources meet their targets) and byte-level BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, jaccard, mixing, rules, suffixes
from tessera.llm.shared import documents, drop_saved, saved, saved_count


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the hashes of the ids and of the text they decode to."""
    import public_tokenizers as vocab
    return bpe.encode_documents(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, keep=["doc_id", "source"])


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing", mix), ("byte-level BPE", tokenize)]

#: SQL can't express the merges of BPE; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs, before = documents(spark, sf_dir), saved_count()
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
        drop_saved(spark, since=before, keep=1)  # what led to these rows is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
