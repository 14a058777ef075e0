"""Page snapshots (O04) and site-map sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.site import split_url

# --- fixed values --------------------------------------------------------
MAX_BODY_BYTES = 5 * 1024 * 1024
# -------------------------------------------------------------------------


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet",
               max_bytes: int = MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """Load a snapshot of (page_id, url, html); split the URL into site
    (origin) and path ('/' when empty); reject bodies over ``max_bytes``
    (UTF-8 bytes) with reason 'too_large'. Returns (accepted, rejects)."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        # self-describing formats are read with the fixed schema, not inferred
        reader = reader.schema("page_id long, url string, html string")
    df = reader.load(path).select("page_id", "url", "html")
    df = split_url(df).withColumn("n_bytes", F.octet_length(F.coalesce("html", F.lit(""))).cast("long"))
    accepted = df.where(F.col("n_bytes") <= max_bytes)
    rejects = df.where(F.col("n_bytes") > max_bytes).drop("html").withColumn("reason", F.lit("too_large"))
    return accepted, rejects


def write_site_maps(site_maps: DataFrame, path: str, mode: str = "overwrite", buckets: int = 0) -> None:
    """One JSON object per site (JSON lines), written by the executors.
    With ``buckets`` > 0 the output is split into folders by a hash of the
    site (``bucket=<n>``), so millions of sites do not land in one folder."""
    if buckets > 0:
        site_maps = site_maps.withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)))
        site_maps.write.mode(mode).partitionBy("bucket").json(path)
    else:
        site_maps.write.mode(mode).json(path)


def save_pages_bucketed(pages: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Save a page snapshot bucketed (and sorted) by page_id, so per-page
    operators read it already partitioned and need no exchange."""
    (pages.write.mode(mode).format("parquet").bucketBy(buckets, "page_id").sortBy("page_id")
     .saveAsTable(table))
