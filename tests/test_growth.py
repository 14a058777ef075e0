"""Plans and expressions that large tables need: what was slow is not there any more."""
import random
import re

from pyspark.sql import functions as F

from tessera.functions.text import WS_CHARS
from tessera.operators import lines as LN
from tessera.operators import outline as O
from tessera.operators import site as S
from tessera.plans.site import crawl_corpus, q_site_map_json
from tessera.plans.synth import synth_html, synth_links, synth_markdown, synth_python, synth_typescript, web_corpus
from tessera.plans.web import q_actions_for_path
from tessera.sources.files import split_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_coverage_sorts_no_files(spark):
    files = spark.createDataFrame([(1, "a.py"), (2, "b.go"), (3, "c.go"), (4, "d.xyz"), (5, "e"), (6, "f.xyz")], "file_id long, path string")
    files = LN.files_from_text(files.withColumn("text", F.lit("x")), "file_id", "path", "text")
    counts = spark.createDataFrame([(1, 3), (3, 2), (6, 1)], "file_id long, n_symbols int")
    out = LN.language_coverage(files, counts)
    grouping = _plan(out).partition("Join")[0]
    # strings can't be kept as a running largest value: only the few rows by language and note are sorted
    assert grouping.count("SortAggregate") == 2 and grouping.count("HashAggregate") - grouping.count("ObjectHashAggregate") == 2
    got = {r["language"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"Python": (1, 1, 3, 0, None), "Go": (2, 0, 2, 1, "unscanned"), "text": (3, 0, 1, 2, "unrecognised")}


def test_sources_share_one_exchange_of_lineitems(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8), (None, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 2, 5, 1), (1, 1, 6, 1), (1, 1, 6, 1), (2, 1, None, 1), (None, 1, 1, 1)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    py, ts = synth_python(spark, str(tmp_path)), synth_typescript(spark, str(tmp_path))
    partial = [re.findall(r"partial_collect_list\(.*", re.sub(r"#\d+L?", "", _plan(df))) for df in (py, ts)]
    assert partial[0] and partial[0] == partial[1]
    assert [r["text"].count("def line_1(self, part=6)") for r in py.where("file_id % 10 = 1").collect()] == [2]
    assert [r["text"].count("def line_") for r in py.where("file_id % 10 = 2").collect()] == [0]  # a null part number
    assert [r["text"] for r in ts.where("file_id % 10 = 2").collect()] == [
        "export class Order2 {\n  line1(part: number): number {\n    return part * 1;\n  }\n}\n\nexport const total2 = (x: number) => x * 2;\n"]


def test_line_facts_by_plain_searches(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("([{)]}=>; \t  xé:") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows += ["=>", "= >", "x =  >  ", ">", "=>;", "  \t x"]
    x = F.col("x")
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    plan = _plan(O._python_facts(df.select(F.lit(1).alias("file_id"), x.alias("text")))) + _plan(O._js_facts(df.select(F.lit(1).alias("file_id"), x.alias("text"))))
    assert "translate(" not in plan  # one table look-up a character
    got = df.select("x", O._balance(x, "([{", ")]}").alias("b"), O._ltrim(x).alias("l"), O._rtrim(x).alias("r"), O._newlines(F.concat(x, F.lit("\n"), x)).alias("n")).collect()
    for r in got:
        t = r["x"]
        assert r["b"] == sum(c in "([{" for c in t) - sum(c in ")]}" for c in t)
        assert (r["l"], r["r"], r["n"]) == (t.lstrip(WS_CHARS), t.rstrip(WS_CHARS), "\n")
    facts = O._js_facts(df.select(F.monotonically_increasing_id().alias("file_id"), x.alias("text"))).where(F.size("facts") > 0)
    seen = {(f["arrow"], f["semi"]) for r in facts.collect() for f in r["facts"]}
    assert {(True, False), (False, True), (False, False)} == seen


def test_lines_and_gutters(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\r\r\nb\r", "\r\n\n\r", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(split_lines(F.col("t")).alias("l"))
    assert "\\r?\\n" not in _plan(rows)  # a pattern would be compiled for every text
    assert [r["l"] for r in rows.collect()] == [[], ["a"], ["a"], ["a", "b"], ["a\r", "b\r"], ["", "", "\r"], []]
    out = spark.range(1).select(LN.numbered(F.array(F.lit("x"), F.lit(None), F.lit("é")), F.lit(99_998)).alias("n"))
    assert "format_string" not in _plan(out)
    assert out.first()["n"] == "99998 │ x\n99999 │ null\n100000 │ é"


def test_sources_are_spread_over_the_sessions_parts(spark, tmp_path):
    spark.range(1, 400).selectExpr("id o_orderkey", "id o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 800).selectExpr("1 + id % 300 l_orderkey", "1 + int(id / 300) l_linenumber", "id l_partkey", "id l_suppkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (synth_python(spark, str(tmp_path)), synth_typescript(spark, str(tmp_path))):
        rows = df.select(F.length("text"), F.spark_partition_id().alias("p")).collect()
        assert len(rows) == 399 and len({r["p"] for r in rows}) == parts  # one part before


def test_blocks_are_folded_once_a_file(spark):
    files = spark.createDataFrame([
        (1, "class A:\n    def f(self,\n          x):\n        return '''\nclass B:\n'''\n\n    # note\ndef g(): pass\nasync def h("), (2, None), (2, "x = 1"),
        (3, "\r\nclass\u2003C:\r\n\u00a0\tdef k(a):\r\n\u00a0\t  '''a'''\r\n")], "file_id long, text string")
    plan = _plan(O.python_symbols(files)) + _plan(O.js_symbols(files))
    assert "aggregate(" not in plan and plan.count("MapInArrow") == 2  # an interpreted fold looked at every line before
    got = sorted(tuple(r) for r in O.python_symbols(files).collect())
    assert got == [(1, "class", "A", 1, 6), (1, "def", "f", 2, 6), (1, "def", "g", 9, 9), (1, "def", "h", 10, 10), (3, "class", "C", 2, 4), (3, "def", "k", 3, 4)]
    js = spark.createDataFrame([(1, "export class A {\n  m(a) {\n    return a;\n  }\n}\nconst f = (x) =>\n  x + 1;\nconst g = (x) => {\n} =>\n;\nfunction h()\n// {\n")], "file_id long, text string")
    assert sorted(tuple(r) for r in O.js_symbols(js).collect()) == [
        (1, "arrow fn", "f", 6, 7), (1, "arrow fn", "g", 8, 10), (1, "class", "A", 1, 5), (1, "function", "h", 11, 11), (1, "method", "m", 2, 4)]


def test_texts_are_lexed_and_nested_in_the_task_that_folds_them(spark):
    files = spark.createDataFrame([
        (1, "Python", "def f(a='):', # (\n      b=\"(\"):\n  '''x\nclass N:\n  '''\n  def g(): pass\nclass C: pass"),
        (2, "TypeScript", "class A {\n  m(a) { // }\n    let b = '}' + \"\\\"}\" + `}`; /* }\n} */\n  }\n}\n"),
        (3, "Markdown", "# a\n## b"), (None, "Python", "class A:\n  def f(): 1"), (4, "Python", None)], "file_id long, language string, text string")
    flat, tree = O.outline_symbols(files), O.outline_tree(files)
    plan = _plan(O.python_symbols(files)) + _plan(O.js_symbols(files))
    assert "regexp_extract_all(" not in plan and "zip_with(" not in plan  # before, each text was lexed in two passes and sent twice
    want = {(1, "def", "f", 1, 6, 1, None), (1, "def", "g", 6, 6, 2, 1), (1, "class", "C", 7, 7, 1, None), (2, "class", "A", 1, 6, 1, None), (2, "method", "m", 2, 5, 2, 1),
            (3, "h1", "a", 1, None, 1, None), (3, "h2", "b", 2, None, 1, None), (None, "class", "A", 1, 2, 1, None), (None, "def", "f", 2, 2, 2, 1)}
    assert {tuple(r) for r in tree.collect()} == want == {tuple(r) for r in O.nest_symbols(flat).collect()}
    assert {tuple(r) for r in flat.collect()} == {w[:5] for w in want}


def test_nesting_keeps_odd_symbols(spark):
    rows = [(1, "a", None, None, 5), (1, "b", "x", 1, 9), (1, "c", "y", 2, None), (1, "d", "z", 3, 12), (1, "e", "v", 10, 11), (1, "e", "v", 10, 11), (1, "f", "w", 13, 2), (2, "g", "u", 4, 4)]
    got = O.nest_symbols(spark.createDataFrame(rows, "file_id long, kind string, name string, start_line int, end_line int"))
    assert "aggregate(" not in _plan(got)  # an interpreted fold before
    assert sorted((r["kind"], r["depth"], r["parent_start"]) for r in got.collect()) == [
        ("a", 1, None), ("b", 1, None), ("c", 2, 1), ("d", 2, 1), ("e", 3, 3), ("e", 4, 10), ("f", 1, None), ("g", 1, None)]


def test_fetch_symbol_searches_by_one_look_first(spark):
    files = spark.createDataFrame([(1, ["Alpha x", "be\nta", None, "\u0391\u03a3"]), (2, []), (3, None)], "file_id long, lines array<string>")
    files = files.withColumn("total_lines", F.size("lines"))
    req = [(1, t) for t in ("ALPHA", "x\nbe", "be\nTA", "\u03b1\u03c2", "", "zz", None)] + [(2, "x"), (3, "x")]
    out = O.fetch_symbol(files, spark.createDataFrame([], "file_id long, kind string, name string, start_line int, end_line int, depth int"),
                         spark.createDataFrame(req, "file_id long, target string"))
    assert "array_join(lines" in re.sub(r"#\d+", "", _plan(out))  # every line was looked at before
    got = {(r["file_id"], r["target"]): (r["status"], r["occurrences"], r["hit_lines"]) for r in out.collect()}
    assert got == {(1, "ALPHA"): ("text", 1, [1]), (1, "x\nbe"): ("none", 0, []), (1, "be\nTA"): ("text", 1, [2]), (1, "\u03b1\u03c2"): ("text", 1, [4]),
                   (1, ""): ("text", 3, [1, 2, 4]), (1, "zz"): ("none", 0, []), (1, None): ("none", 0, []), (2, "x"): ("none", 0, []), (3, "x"): ("none", None, None)}


def test_documents_of_customers_are_spread_and_actions_written_once(spark, tmp_path):
    spark.range(1, 400).selectExpr("id c_custkey", "concat('n', id) c_name", "'S' c_mktsegment", "id % 25 c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("id n_nationkey", "'N' n_name", "1 n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    page = ("<button data-href='/c/1'>a</button><a href='/c/12'>b</a>", "<button>c</button>")
    spark.createDataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (synth_html(spark, str(tmp_path)), synth_markdown(spark, str(tmp_path))):
        rows = df.select(df.columns[-1], F.spark_partition_id().alias("p")).collect()
        assert len(rows) == 100 and len({r["p"] for r in rows}) == parts  # one part before
    spark.range(200).selectExpr("id page_id", "'https://x.example/' || id url", "'<p>x' html").coalesce(1).write.parquet(f"{tmp_path}/many/pages.parquet")
    for t in ("customer", "nation"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/many/{t}.parquet")
    rows = web_corpus(spark, f"{tmp_path}/many", spread=True).select("html", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 200 and len({r["p"] for r in rows}) == parts  # one row group, one task
    found = q_actions_for_path(spark, str(tmp_path))
    assert "regexp_extract_all" not in _plan(found)  # the pages were read through twice before
    assert [(r["page_id"], r["action_no"], r["type"]) for r in found.where("path = '/c/1' and page_id < 9").orderBy("action_no").collect()] == [(0, 1, "button"), (0, 2, "link")]


def test_site_maps_join_written_facts(spark, tmp_path):
    spark.range(1, 400).selectExpr("id c_custkey", "concat('n', id) c_name", "'S' c_mktsegment", "id % 25 c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("id n_nationkey", "'N' n_name", "1 n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "https://x.example/", "<title>T</title><button>b</button><form><input name='q'></form><a href='/gone'>g</a>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (synth_links(spark, str(tmp_path)), crawl_corpus(spark, str(tmp_path))):
        rows = df.select("html", F.spark_partition_id().alias("p")).collect()
        assert len(rows) >= 399 and len({r["p"] for r in rows}) == parts  # the linked pages were one part before
    maps = q_site_map_json(spark, str(tmp_path))
    # before, the pages' work was in the same plan, and a small table's broadcast waited for its tasks
    assert "regexp_extract_all(" not in _plan(maps) and "aggregate(" not in _plan(maps)
    got = maps.where("site = 'https://x.example'").select(F.from_json(
        "json", "pages_scanned int, pages_failed int, pages array<struct<path:string,title:string>>, forms array<struct<fields:array<string>>>, actions array<struct<label:string>>").alias("m")).first()["m"]
    assert (got["pages_scanned"], got["pages_failed"], got["pages"][0]["title"]) == (1, 1, "T")
    assert [f["fields"] for f in got["forms"]] == [["q"]] and [a["label"] for a in got["actions"]] == ["b", "g"]


def test_site_maps_keep_rows_without_a_page_out_of_the_join(spark):
    walk = spark.createDataFrame([("s", "/", 1, 0, "mapped", 7, "s", "/"), ("s", "/a", 2, 1, "missing", None, "s", "/a"), ("s", "/b", None, 1, "unvisited", None, "s", "/b"), (None, "/", 1, 0, "missing", None, None, "/")],
                                 "site string, path string, rank long, level int, outcome string, page_id long, final_site string, final_path string")
    facts = spark.createDataFrame([(7, "T", "S", [("/", ["q"], "/", "GET")], ["/api"], True), (None, "no", "no", [], [], False)],
                                  "page_id long, title string, summary string, forms array<struct<page:string,fields:array<string>,action:string,method:string>>, api_hints array<string>, auth_required boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.site_awareness(walk, facts)
        assert "isnull(page_id" in _plan(out)  # all of them went to one task before
        got = {r["site"]: (r["pages_scanned"], r["pages_failed"], r["links_queued_unvisited"], r["pages"], r["api_hints"], r["auth_required"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"s": (1, 1, 1, [("/", "T", "S", None)], ["/api"], True), None: (0, 1, 0, [], [], False)}


def test_fetch_symbol_exchanges_names_once_and_lines_as_text(spark):
    files = spark.createDataFrame([(1, ["def one():", "  x", None]), (2, ["a\nB"]), (3, []), (4, [""]), (5, ["p", "q"])], "file_id long, lines array<string>").withColumn("total_lines", F.size("lines"))
    nested = spark.createDataFrame([(1, "class", "A", 1, 2, 1), (1, "def", "a", 2, 2, 2), (1, "def", "Solo", 2, 3, 1), (1, "def", "one", 1, 2, 1), (1, "def", "deep", 1, 1, 3), (5, "def", None, 1, 1, 1),
                                    (5, "h1", "p", 1, None, 1), (None, "def", "one", 1, 1, 1)], "file_id long, kind string, name string, start_line int, end_line int, depth int")
    req = [(1, "A"), (1, "a"), (1, "solo"), (1, "solo"), (1, "ONE"), (1, "deep"), (2, "b"), (2, "a\nb"), (3, ""), (4, ""), (5, "P"), (5, None), (None, "one"), (9, "one")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = O.fetch_symbol(files, nested, spark.createDataFrame(req, "file_id long, target string"))
        assert _plan(out).count("Exchange hashpartitioning") == 2  # five before
        got = {(r["file_id"], r["target"]): (r["status"], r["n_matches"], r["candidates"], r["hit_lines"], r["body"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    two, solo = ["class A  lines 1–2", "def a  lines 2–2"], "def Solo  lines 2–3"
    assert got == {(1, "A"): ("ambiguous", 2, two, None, None), (1, "a"): ("ambiguous", 2, two, None, None), (1, "solo"): ("ambiguous", 2, [solo, solo], None, None),
                   (1, "ONE"): ("symbol", 1, None, None, "    1 │ def one():\n    2 │   x"), (1, "deep"): ("none", 0, None, [], None), (2, "b"): ("text", 0, None, [1], None),
                   (2, "a\nb"): ("text", 0, None, [1], None), (3, ""): ("none", 0, None, [], None), (4, ""): ("text", 0, None, [1], None), (5, "P"): ("text", 1, None, [1], None),
                   (5, None): ("none", 0, None, [], None)}
