"""Registered file queries: the documents table read as text files plus
Python, TypeScript and Markdown sources synthesised from orders, lineitem,
customer and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lines as LN
from tessera.plans.synth import file_corpus
from tessera.sources.files import admit_text, confine_paths

SEARCH_LITERAL = "the"
SEARCH_REGEX = r"ti[oó]n[.,]"
ROOTS = ["src1", "synth/md"]


def _files(spark, d):
    return LN.files_from_text(file_corpus(spark, d), "file_id", "path", "text")


def q_file_lines(spark, d):
    return LN.explode_lines(_files(spark, d))


def q_file_language(spark, d):
    return _files(spark, d).select("file_id", "name", "language", "total_lines")


def q_admit_text(spark, d):
    c = file_corpus(spark, d).select("file_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    c = c.withColumn("length", F.octet_length("content").cast("long"))
    return admit_text(c).select("file_id", F.col("length").alias("n_bytes"), "status")


def q_confine_paths(spark, d):
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    return confine_paths(_files(spark, d).select("file_id", "path"), roots)


def q_search_lines(spark, d):
    return LN.search_lines(_files(spark, d), SEARCH_LITERAL, ctx=0).select("file_id", "line_no", "line")


def q_search_regex(spark, d):
    return LN.search_lines(_files(spark, d), SEARCH_REGEX, regex=True, ctx=0).select("file_id", "line_no", "line")


def q_search_context(spark, d):
    return LN.search_lines(_files(spark, d), SEARCH_LITERAL, ctx=5).select(
        "file_id", "line_no", "before", "after")


def q_search_top(spark, d):
    return LN.search_lines(_files(spark, d), SEARCH_LITERAL, ctx=5, max_results=20).select(
        "file_id", "rank", "line_no", "occurrences")


def q_trim_match(spark, d):
    hits = LN.search_lines(_files(spark, d), SEARCH_LITERAL, ctx=5, max_results=20)
    return LN.trimmed_hits(hits, SEARCH_LITERAL)


def q_trimmed_per_file(spark, d):
    return LN.trimmed_per_file(q_trim_match(spark, d))


def q_read_chunk(spark, d):
    f = _files(spark, d)
    req = (f.select("file_id", F.lit(2).alias("start"), F.lit(4).alias("end"))
           .unionByName(f.select("file_id", (F.col("total_lines") - 1).alias("start"), (F.col("total_lines") + 5).alias("end")))
           .unionByName(f.select("file_id", F.lit(100000).alias("start"), F.lit(100010).alias("end"))))
    return LN.read_chunk(f, req)


QUERIES = {
    "file_lines": q_file_lines,
    "file_language": q_file_language,
    "admit_text": q_admit_text,
    "confine_paths": q_confine_paths,
    "search_lines": q_search_lines,
    "search_regex": q_search_regex,
    "search_context": q_search_context,
    "search_top": q_search_top,
    "trim_match": q_trim_match,
    "trimmed_per_file": q_trimmed_per_file,
    "read_chunk": q_read_chunk,
}
