"""Physical-plan checks: the properties the design relies on at scale."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from samples import SF_SMALL
from tessera.operators.html import clean_pages
from tessera.operators.outline import outline_tree
from tessera.operators.pages import page_title


def _final_plan(df):
    """The adaptive plan as executed (the part before its initial plan)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_page_bytes_are_not_exchanged(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    assert "Exchange" not in _final_plan(clean_pages(pages).select("page_id", "text", "cuts"))


def test_file_text_is_not_exchanged(spark):
    files = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("file_id"), "text", F.lit("Python").alias("language"))
    assert "Exchange" not in _final_plan(outline_tree(files))


def test_scan_reads_only_needed_columns(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    plan = pages.select("page_id", page_title(F.col("html")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.col("lang") == "en").select("doc_id")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_crawl_ranking_keeps_a_map_side_top_k(spark):
    first = spark.range(100).select((F.col("id") % 3).cast("string").alias("site"),
                                    F.struct(F.col("id").alias("parent_rank"), F.lit(1).alias("link_no")).alias("o"))
    w = Window.partitionBy("site").orderBy(F.col("o.parent_rank"), F.col("o.link_no"))
    plan = first.withColumn("rn", F.row_number().over(w)).where("rn <= 10")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bucketed_pages_need_no_exchange(spark):
    import tempfile
    from tessera.sources.pages import save_pages_bucketed
    wh = tempfile.mkdtemp(prefix="tessera-wh-")
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tessera_t LOCATION '{wh}'")
    save_pages_bucketed(pages, "tessera_t.pages_b", 8)
    b = spark.table("tessera_t.pages_b")
    df = clean_pages(b).select("page_id", "text")
    plan = _final_plan(df)
    assert "Exchange" not in plan
    want = {r.page_id: r.text for r in clean_pages(pages).select("page_id", "text").collect()}
    assert {r.page_id: r.text for r in df.collect()} == want
