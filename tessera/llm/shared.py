"""Helpers shared by the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import drop_saved, saved, saved_count  # noqa: F401  (for the operators)

#: The six white-space bytes that separate words, as a Java and DuckDB class.
SPACE = r"\x20\x09-\x0D"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send batches of BATCH_BYTES (or one row): with whole texts, batches by number
    of rows take tens of megabytes on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE}]+"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents kept out of training; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
