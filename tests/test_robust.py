"""Degenerate and hostile inputs go through every operator without errors."""
from pyspark.sql import functions as F

from tessera.functions.text import tags_to_text
from tessera.operators import elements as E
from tessera.operators import html as H
from tessera.operators import lines as LN
from tessera.operators import links as L
from tessera.operators import outline as O
from tessera.operators import pages as P

WEIRD_PAGES = [
    (None, None), ("", ""), ("not a url", "<a href='/x'>x</a>"), ("mailto:a@b", "<a href='y'>y</a>"),
    ("http://h/", "<div title=\"unbalanced>text</div><p>&#xD800;&#99999999999;&;&#;</p>"),
    ("http://h/", "<nav><nav><nav>deep</nav></nav>"), ("http://h/", "<" * 5000 + ">" * 5000),
    ("http://h/", "<form><input name=a><input name=a></form><form action=''></form>"),
    ("http://h:99999/p", "<a href='http://[::1'>bad</a><a href='//'>e</a><a href='?'>q</a><a href='#'>f</a>"),
]


def test_page_operators_on_weird_pages(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(WEIRD_PAGES)], "page_id long, url string, html string")
    c = H.clean_pages(df, extras={"title": P.page_title(F.coalesce(F.col("html"), F.lit("")))})
    assert c.count() == len(WEIRD_PAGES)
    P.page_sections(c).collect()
    P.search_pages(c, "x").collect()
    L.split_anchors(L.extract_links(df)).collect()
    E.extract_forms(df).collect()
    E.extract_actions(df).collect()
    df.select(P.api_hints_quoted(F.coalesce("html", F.lit(""))), P.api_hints_script(F.coalesce("html", F.lit(""))),
              P.auth_required_word(tags_to_text(F.coalesce("html", F.lit(""))))).collect()
    urls = df.select(F.col("page_id").alias("url_id"), F.coalesce("url", F.lit("")).alias("url"))
    assert L.classify_destination(urls).count() == len(WEIRD_PAGES)


def test_file_operators_on_weird_files(spark):
    texts = [None, "", "\n\n\n", "\r\n", "def f(:\n  '''never closed\n", "class A:\n\tdef b(self): pass\n",
             "x" * 100_000, "\n".join(["}"] * 50 + ["{"] * 50), "# h\n```\n# in\n", "const a = (\n"]
    names = ["a.py", "b.py", "c.ts", "d.ts", "e.py", "f.py", "g.py", "h.ts", "i.md", "j.ts"]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(names, texts))], "file_id long, path string, text string")
    src = df.withColumn("language", LN.language_of(F.col("path")))
    nested = O.nest_symbols(O.outline_symbols(src))
    nested.collect()
    O.outline_depth(nested, 1).collect()
    files = LN.files_from_text(df, "file_id", "path", "text")
    LN.search_lines(files, "x", ctx=3, max_results=2).collect()
    req = spark.createDataFrame([(i, "a") for i in range(10)], "file_id long, target string")
    O.fetch_symbol(files, nested, req).collect()
