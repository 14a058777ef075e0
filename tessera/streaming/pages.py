"""Page operators on Structured Streaming.

The per-page expressions (title, summary-free facts, API hints, auth
signals, links' raw hrefs, admission by size) are stateless and run on a
streaming DataFrame unchanged. Clean text needs the token windows, which
streaming does not allow without event time, so it runs per micro-batch
through ``foreachBatch``: each batch is an ordinary DataFrame, and the
output is written under its epoch id (overwrite), so a replayed batch
replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import spoken_html, tags_to_text
from tessera.operators.html import clean_pages
from tessera.operators.pages import (api_hints_quoted, auth_required_substring, auth_required_word,
                                     page_summary, page_title)
from tessera.sources.pages import MAX_BODY_BYTES

PAGES_SCHEMA = "page_id long, url string, html string"


def read_page_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A stream of (page_id, url, html) from parquet files landing in ``path``."""
    return (spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def page_facts(pages: DataFrame) -> DataFrame:
    """Stateless per-page facts; works on batch and streaming DataFrames."""
    html = F.coalesce(F.col("html"), F.lit(""))
    raw_text = tags_to_text(html)
    return pages.where(F.octet_length(html) <= MAX_BODY_BYTES).select(
        "page_id", "url", page_title(html).alias("title"), api_hints_quoted(html).alias("api_hints"),
        auth_required_word(raw_text).alias("auth_word"), auth_required_substring(tags_to_text(spoken_html(html))).alias("auth_substring"))


def clean_batch(batch: DataFrame) -> DataFrame:
    """Clean text, title and summary of one micro-batch."""
    c = clean_pages(batch, extras={"title": page_title(F.col("html"))})
    return c.select("page_id", "title", "text", page_summary(F.col("text")).alias("summary"), "cuts", "kept", "unclosed")


def start_clean_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                       trigger_once: bool = False):
    """Start a query that writes clean pages of each micro-batch to
    ``sink/epoch=<id>`` (overwritten on replay, so output is exactly once)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        clean_batch(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")

    w = read_page_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
