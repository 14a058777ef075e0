import glob
import tempfile

from samples import SF_SMALL
from tessera.streaming.pages import page_facts, read_page_stream, start_clean_stream


def test_page_facts_on_a_stream(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-facts-")
    spark.read.parquet(f"{SF_SMALL}/pages.parquet").write.mode("overwrite").parquet(f"{src}/part")
    stream = page_facts(read_page_stream(spark, f"{src}/part"))
    q = stream.writeStream.format("memory").queryName("facts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = page_facts(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))
    assert sorted(spark.sql("SELECT * FROM facts").collect()) == sorted(batch.collect())


def test_clean_text_per_micro_batch(spark):
    out = tempfile.mkdtemp(prefix="tessera-stream-out-")
    ck = tempfile.mkdtemp(prefix="tessera-stream-ck-")
    src = tempfile.mkdtemp(prefix="tessera-stream-src-")
    spark.read.parquet(f"{SF_SMALL}/pages.parquet").write.mode("overwrite").parquet(f"{src}/part")
    q = start_clean_stream(spark, f"{src}/part", out, ck, trigger_once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(*glob.glob(f"{out}/epoch=*"))
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()


def test_line_search_on_a_document_stream(spark):
    from tessera.operators.lines import files_from_text, search_lines
    from tessera.streaming.files import read_document_stream, search_stream
    src = tempfile.mkdtemp(prefix="tessera-stream-docs-")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.write.mode("overwrite").parquet(f"{src}/part")
    q = (search_stream(read_document_stream(spark, f"{src}/part"), "the", max_results=3)
         .writeStream.format("memory").queryName("doc_hits").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    from pyspark.sql import functions as F
    batch = search_lines(files_from_text(docs.select(
        "doc_id", F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "text"), "doc_id", "path", "text"), "the", ctx=2, max_results=3)
    assert sorted(spark.sql("SELECT * FROM doc_hits").collect()) == sorted(batch.collect())
