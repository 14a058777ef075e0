"""File operators on Structured Streaming.

Splitting into lines, the language tag and line search are per-file
expressions (no state), so they run on a stream of documents unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.lines import files_from_text, search_lines

DOCUMENTS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_document_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A stream of documents from parquet files landing in ``path``."""
    return (spark.readStream.schema(DOCUMENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def search_stream(documents: DataFrame, query: str, regex: bool = False, ctx: int = 2,
                  max_results: int | None = None) -> DataFrame:
    """Matching lines (with context and per-file totals) of every arriving
    document; ``path`` is source/doc_<id>.txt as in the batch queries."""
    from pyspark.sql import functions as F
    docs = documents.select("doc_id", F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                                               F.lit(".txt")).alias("path"), "text")
    return search_lines(files_from_text(docs, "doc_id", "path", "text"), query, regex=regex, ctx=ctx,
                        max_results=max_results)
