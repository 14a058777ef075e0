"""Registered outline queries over the synthesised sources, plus the truth
table that follows from the base rows by construction (used by O25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import lines as LN
from tessera.operators import outline as O
from tessera.plans.synth import (MD_FILE_BASE, PY_FILE_BASE, TS_FILE_BASE, file_corpus, order_lines, synth_markdown,
                                 synth_python, synth_typescript)


def _sources(spark, d):
    """The file corpus with its language. Each source carries its language
    as a constant (it follows from the paths the builders write), so a
    filter on one language prunes the other sources from the plan."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "text", F.lit("text").alias("language"))
    return (docs.unionByName(synth_python(spark, d).withColumn("language", F.lit("Python")))
            .unionByName(synth_typescript(spark, d).withColumn("language", F.lit("TypeScript")))
            .unionByName(synth_markdown(spark, d).withColumn("language", F.lit("Markdown"))))


def _symbols(spark, d):
    return O.outline_symbols(_sources(spark, d))


def _nested(spark, d):
    return O.outline_tree(_sources(spark, d))


def truth_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Expected symbols of the synthesised sources, from orders, lineitem,
    customer and nation (line numbers follow from the layout)."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    j = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("j"))
    m = j.groupBy("o_orderkey").agg(F.count("*").alias("m"))
    om = orders.join(m, "o_orderkey", "left").select("o_orderkey", F.coalesce("m", F.lit(0)).alias("m"))
    k = F.col("o_orderkey")
    ks = k.cast("string")
    py_cls = om.select((PY_FILE_BASE + k).alias("file_id"), F.lit("Python").alias("language"), F.lit("class").alias("kind"),
                       F.concat(F.lit("Order"), ks).alias("name"), F.lit(4).alias("start_line"),
                       F.when(F.col("m") > 0, 12 + 3 * (F.col("m") - 1)).otherwise(F.lit(9)).alias("end_line"),
                       F.lit(1).alias("depth"), F.lit(None).cast("int").alias("parent_start"))
    py_m = j.select((PY_FILE_BASE + k).alias("file_id"), F.lit("Python").alias("language"), F.lit("def").alias("kind"),
                    F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("name"),
                    (11 + 3 * (F.col("j") - 1)).alias("start_line"), (12 + 3 * (F.col("j") - 1)).alias("end_line"),
                    F.lit(2).alias("depth"), F.lit(4).alias("parent_start"))
    py_t = om.where(k % 3 == 0).select((PY_FILE_BASE + k).alias("file_id"), F.lit("Python").alias("language"),
                                       F.lit("def").alias("kind"), F.concat(F.lit("total_"), ks).alias("name"),
                                       (11 + 3 * F.col("m")).alias("start_line"), (11 + 3 * F.col("m")).alias("end_line"),
                                       F.lit(1).alias("depth"), F.lit(None).cast("int").alias("parent_start"))
    ts_cls = om.select((TS_FILE_BASE + k).alias("file_id"), F.lit("TypeScript").alias("language"), F.lit("class").alias("kind"),
                       F.concat(F.lit("Order"), ks).alias("name"), F.lit(1).alias("start_line"),
                       (2 + 3 * F.col("m")).alias("end_line"), F.lit(1).alias("depth"),
                       F.lit(None).cast("int").alias("parent_start"))
    ts_m = j.select((TS_FILE_BASE + k).alias("file_id"), F.lit("TypeScript").alias("language"), F.lit("method").alias("kind"),
                    F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"),
                    (2 + 3 * (F.col("j") - 1)).alias("start_line"), (4 + 3 * (F.col("j") - 1)).alias("end_line"),
                    F.lit(2).alias("depth"), F.lit(1).alias("parent_start"))
    ts_a = om.select((TS_FILE_BASE + k).alias("file_id"), F.lit("TypeScript").alias("language"), F.lit("arrow fn").alias("kind"),
                     F.concat(F.lit("total"), ks).alias("name"), (4 + 3 * F.col("m")).alias("start_line"),
                     (4 + 3 * F.col("m")).alias("end_line"), F.lit(1).alias("depth"),
                     F.lit(None).cast("int").alias("parent_start"))
    nation = spark.read.parquet(f"{d}/nation.parquet")
    cust = spark.read.parquet(f"{d}/customer.parquet")
    blk = F.floor(F.col("c_custkey") / 100).cast("long")
    cj = cust.select("c_nationkey", "c_custkey", blk.alias("blk"))
    cj = cj.withColumn("j", F.row_number().over(Window.partitionBy("c_nationkey", "blk").orderBy("c_custkey")))
    md_id = (MD_FILE_BASE + F.col("blk") * 100 + F.col("c_nationkey")).cast("long")
    md_h1 = (cj.select("c_nationkey", "blk").distinct()
             .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
             .select(md_id.alias("file_id"), F.lit("Markdown").alias("language"),
                     F.lit("h1").alias("kind"), F.concat(F.lit("Nation "), F.col("n_name")).alias("name"),
                     F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(1).alias("depth"),
                     F.lit(None).cast("int").alias("parent_start")))
    md_h2 = cj.select(md_id.alias("file_id"), F.lit("Markdown").alias("language"),
                      F.lit("h2").alias("kind"), F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("name"),
                      (3 + 4 * (F.col("j") - 1)).alias("start_line"), F.lit(None).cast("int").alias("end_line"),
                      F.lit(1).alias("depth"), F.lit(None).cast("int").alias("parent_start"))
    out = py_cls
    for x in (py_m, py_t, ts_cls, ts_m, ts_a, md_h1, md_h2):
        out = out.unionByName(x)
    return out.select(F.col("file_id").cast("long").alias("file_id"), "language", "kind", "name",
                      F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
                      F.col("depth").cast("int").alias("depth"), F.col("parent_start").cast("int").alias("parent_start"))


def q_python_symbols(spark, d):
    return O.python_symbols(_sources(spark, d).where(F.col("language") == "Python"))


def q_js_symbols(spark, d):
    return O.js_symbols(_sources(spark, d).where(F.col("language").isin("JavaScript", "TypeScript")))


def q_markdown_headings(spark, d):
    return O.markdown_symbols(_sources(spark, d).where(F.col("language") == "Markdown"))


def q_docstring_mask(spark, d):
    return O.docstring_mask(_sources(spark, d).where(F.col("language") == "Python"))


def q_nest_symbols(spark, d):
    return _nested(spark, d)


def q_nest_symbol_rows(spark, d):
    """The same from a table of symbols."""
    return O.nest_symbols(_symbols(spark, d))


def q_outline_listing(spark, d):
    return O.outline_listing(_nested(spark, d), max_rows=3, offset=1).select(
        "file_id", "row_no", "kind", "name", "start_line", "end_line", "depth", "total", "next_offset")


def q_outline_depth(spark, d):
    return O.outline_depth(_nested(spark, d), max_depth=1).select(
        "file_id", "row_no", "kind", "name", "start_line", "end_line", "hidden_members", "total", "next_offset")


def q_fetch_symbol(spark, d):
    files = LN.files_from_text(file_corpus(spark, d), "file_id", "path", "text")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    # the sources' own exchange of lineitems: the first of an order's items has the line number that is asked for
    first_ln = order_lines(spark, d).select("o_orderkey", F.get("items", F.lit(0))["l_linenumber"].alias("ln"))
    k = F.col("o_orderkey")
    base = orders.join(first_ln.hint("merge"), "o_orderkey", "left").select((PY_FILE_BASE + k).cast("long").alias("file_id"), k.cast("string").alias("ks"), "ln")
    targets = F.array(F.concat(F.lit("Order"), F.col("ks")), F.concat(F.lit("LINE_"), F.col("ln").cast("string")),
                      F.concat(F.lit("fake_"), F.col("ks")), F.concat(F.lit("nothing_"), F.col("ks")))
    # an order without lineitems has no line to ask for; without a key, no file
    req = (base.select("file_id", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("target"))
           # a word in every file, and the headings of every Markdown file (no end: found as text)
           .unionByName(files.select("file_id", F.lit("the").alias("target")))
           .unionByName(O.markdown_symbols(_sources(spark, d).where(F.col("language") == "Markdown")).select("file_id", F.col("name").alias("target")).distinct()))
    return O.fetch_symbol(files, _nested(spark, d), req)


def q_outline_accuracy(spark, d):
    return O.outline_accuracy(_symbols(spark, d), truth_symbols(spark, d).where(F.col("language") != "Markdown"))


def _symbol_counts(spark, d):
    return _symbols(spark, d).groupBy("file_id").agg(F.count("*").cast("int").alias("n_symbols"))


def q_file_summary(spark, d):
    files = LN.files_from_text(file_corpus(spark, d), "file_id", "path", "text")
    return LN.summarize_files(files, _symbol_counts(spark, d))


def q_language_coverage(spark, d):
    files = LN.files_from_text(file_corpus(spark, d), "file_id", "path", "text")
    return LN.language_coverage(files, _symbol_counts(spark, d))


def q_file_notes(spark, d):
    files = LN.files_from_text(file_corpus(spark, d), "file_id", "path", "text")
    return LN.file_notes(files, _symbol_counts(spark, d))


QUERIES = {
    "python_symbols": q_python_symbols,
    "js_symbols": q_js_symbols,
    "markdown_headings": q_markdown_headings,
    "docstring_mask": q_docstring_mask,
    "nest_symbols": q_nest_symbols,
    "nest_symbol_rows": q_nest_symbol_rows,
    "outline_listing": q_outline_listing,
    "outline_depth": q_outline_depth,
    "fetch_symbol": q_fetch_symbol,
    "outline_accuracy": q_outline_accuracy,
    "file_summary": q_file_summary,
    "language_coverage": q_language_coverage,
    "file_notes": q_file_notes,
}
