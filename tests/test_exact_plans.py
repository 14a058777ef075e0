"""One plan whatever the table sizes; elements as a parser sees them; linear pairing; host spellings."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import live_html, spoken_html, tags_to_text
from tessera.operators.elements import actions_for_path, extract_actions, extract_forms
from tessera.operators.lines import files_from_text, search_lines, trimmed_hits, trimmed_per_file
from tessera.operators.links import classify_destination, resolve_redirects, with_resolved_url
from tessera.operators.pages import api_hints_script, auth_required_substring, page_sections
from tessera.sources.files import confine_paths


@pytest.mark.parametrize("n", [1, 1000, 5000])
def test_actions_for_path_is_contains_at_every_size(spark, n):
    actions = [(1, "/a/b/c"), (2, "/a/b/c"), (2, "/a/b/c"), (3, ""), (4, None), (5, "https://x.example/very/long/path?q=1")]
    wanted = ["", "/a", "b/c", "long/path?q", "/a/b/c", "/a/b/c", "/nowhere/at/all"] + [f"/none/{k}" for k in range(n)]
    out = actions_for_path(spark.createDataFrame(actions, "page_id long, leads_to string"), spark.createDataFrame([(p,) for p in wanted], "path string"))
    expected = sorted((a, t, p) for a, t in actions if t is not None for p in wanted if p in t)
    assert sorted((r["page_id"], r["leads_to"], r["path"]) for r in out.collect()) == expected


def test_confined_paths(spark):
    files = spark.createDataFrame([("src1/a", 1), ("src10/a", 2), ("src1", 3), ("src1/a", 1), (None, 5)], "path string, k int")
    roots = lambda *r: spark.createDataFrame([(x,) for x in r], "root string")
    keys = lambda df: sorted(r["k"] for r in df.collect())
    assert keys(confine_paths(files, roots("src1/", "src1"))) == [1, 1, 3]
    assert keys(confine_paths(files, roots())) == [1, 1, 2, 3, 5]
    assert keys(confine_paths(files, roots("other", *[f"r{k}" for k in range(3000)]))) == []


def test_search_edges(spark):
    files = files_from_text(spark.createDataFrame([(1, "a.txt", "foo\n" + "x" * 2000 + "foo")], "i long, p string, t string"), "i", "p", "t")
    assert search_lines(files, "foo", max_results=0).count() == 0
    with pytest.raises(ValueError):
        search_lines(files, "fo(", regex=True)
    assert trimmed_per_file(trimmed_hits(search_lines(files, "foo", ctx=0), "foo")).collect()[0]["n_trimmed"] == 1


def test_elements_in_comments_and_scripts_are_not_elements(spark):
    html = ("<!-- <button>Old</button><a href='/dead'>Dead</a><i data-x='/api/old'></i> --><script>var s = '<button>Ghost</button>'; function login(){}</script>"
            "<button>Real</button><a href='/x'>Go<!-- no --></a><form><input type=text name=q></form><i data-x='/api/new'></i>")
    pages = spark.createDataFrame([(1, "https://e.example/", html)], "page_id long, url string, html string")
    assert [r["label"] for r in extract_actions(pages).orderBy("action_no").collect()] == ["Real", "Go", "q"]
    r = pages.select(api_hints_script(F.col("html")).alias("h"), auth_required_substring(tags_to_text(spoken_html(F.col("html")))).alias("a")).collect()[0]
    assert r["h"] == ["/api/new"] and r["a"] is False


def test_openings_without_a_closing_cost_linear_time(spark):
    size = 400_000
    pages = spark.createDataFrame([(k, "https://e.example/", t * (size // len(t))) for k, t in enumerate(["<a href='/x'>y ", "<form><input name=a>", "<button>b", "<!-- c"])],
                                  "page_id long, url string, html string")
    began = time.time()
    assert extract_actions(pages).count() == 0 and extract_forms(pages).count() == 0
    assert time.time() - began < 60


def test_every_spelling_of_a_reserved_host_is_blocked(spark):
    bad = ["http://2130706433/", "http://0x7f000001/", "http://127.1/", "http://[0:0:0:0:0:0:0:1]/", "http://[::ffff:7f00:1]/", "http:/127.0.0.1/",
           "http://127.0.0.1./", "http://10.0.0.1:80/", "http://0177.0.0.1/", "http:\\\\10.1.1.1\\x", "http://%31%32%37.0.0.1/", "http://1.2.3.256/"]
    good = ["http://93.184.216.34/", "https://example.com:8443/a", "http://[2606:2800::1]/", "http://1572395042/", "http://10.0.0.2:8080/"]
    urls = spark.createDataFrame([(0, u) for u in bad + good], "url_id long, url string")  # ids may repeat
    allow = spark.createDataFrame([("10.0.0.1:80",), ("10.0.0.2:8080",)], "entry string")
    status = {r["url"]: r["status"] for r in classify_destination(urls, allow).collect()}
    assert {u for u in bad if status[u] == "allowed"} == set() and {status[u] for u in good} == {"allowed"}


def test_redirect_stops(spark):
    starts = spark.createDataFrame([(1, "http://A.example/z"), (2, "http://a.example/e"), (3, "http://a.example/b"), (4, "http://a.example/p"), (5, "http://127.1/")],
                                   "start_id long, url string")
    hops = spark.createDataFrame([("http://a.example/z", "/y"), ("http://a.example/e", ""), ("http://a.example/b", "http://"),
                                  ("http://a.example/p", "http://0x7f000001/q"), ("http://a.example/z", "/y")], "url string, location string")
    got = {r["start_id"]: (r["status"], r["n_hops"]) for r in resolve_redirects(starts, hops).collect()}
    assert got == {1: ("ok", 1), 2: ("no_location", 0), 3: ("bad_location", 0), 4: ("blocked", 0), 5: ("blocked", 0)}


def test_backslashes_and_coded_dots_in_links(spark):
    df = spark.createDataFrame([("\\x\\y", "https://e.example/d/p"), ("/a/%2e%2e/b", "https://e.example/d/p"), ("/a/%2E/b?x=\\", "https://e.example/")], "h string, b string")
    out = [r["target_url"] for r in with_resolved_url(df, "h", "b").collect()]
    assert out == ["https://e.example/x/y", "https://e.example/b", "https://e.example/a/b?x=\\"]


def test_walk_through_redirects(spark):
    from tessera.operators.site import crawl_snapshot, site_awareness
    site = "https://s.example"
    snap = spark.createDataFrame([(site, "/", 1), (site, "/a", 2), (site, "/b", 3)], "site string, path string, page_id long")
    edges = spark.createDataFrame([(1, 1, "/old-a"), (1, 2, "/a"), (1, 3, "/out"), (1, 4, "/none"), (2, 1, "/b")], "page_id long, link_no int, target_path string")
    red = spark.createDataFrame([(site, "/old-a", site, "/a"), (site, "/out", "https://t.example", "/")], "site string, path string, final_site string, final_path string")
    walk = crawl_snapshot(snap, edges, spark.createDataFrame([(site, "/")], "site string, path string"), redirects=red)
    got = {r["path"]: (r["rank"], r["outcome"], r["page_id"]) for r in walk.collect()}
    assert got == {"/": (1, "mapped", 1), "/old-a": (2, "mapped", 2), "/a": (3, "duplicate", None), "/out": (4, "off_origin", None),
                   "/none": (5, "missing", None), "/b": (6, "mapped", 3)}
    facts = spark.createDataFrame([(k, f"T{k}", "s", [], [], False, [("link", "go", "/b", None)], f"text {k}") for k in (1, 2, 3)],
                                  "page_id long, title string, summary string, forms array<string>, api_hints array<string>, auth_required boolean, "
                                  "actions array<struct<type:string,label:string,leads_to:string,endpoint:string>>, content string")
    m = site_awareness(walk, facts).collect()[0]
    assert [p["path"] for p in m["pages"]] == ["/", "/a", "/b"] and m["pages"][1]["content"] == "text 2" and len(m["actions"]) == 3
    assert m["off_origin_redirects_skipped"] == ["https://s.example/out -> https://t.example/"] and m["pages_failed"] == 1


@pytest.mark.parametrize("text", ["<h1>" * 1_300_000 + "</h2>", "<style>" * 700_000 + "</script>", "<script " * 600_000 + "</script>",
                                  "<!--" * 600_000 + "<style></script>" * 150_000, "<" * 5_000_000])
def test_mixed_openings_and_closings_cost_linear_time(spark, text):
    pages = spark.createDataFrame([(1, "https://e.example/", text)], "page_id long, url string, html string")
    began = time.time()
    assert page_sections(pages.withColumnRenamed("html", "kept_html")).count() == 0 and extract_actions(pages).count() == 0 and extract_forms(pages).count() == 0
    r = pages.select(api_hints_script(F.col("html")).alias("h"), auth_required_substring(tags_to_text(spoken_html(F.col("html")))).alias("a")).collect()[0]
    assert r["h"] == [] and r["a"] is False
    assert time.time() - began < 90


def test_pairing_equals_the_plain_pattern(spark):
    """Marked openings change no match: random mixtures against one sequential pattern."""
    rng = random.Random(5)
    bits = ["<script>", "</script>", "<style a='1'>", "</style >", "<!--", "-->", "<!-->", "text ", "<scripty>", "</scripts>", "<script ", ">", "<template>", "</template>", "<b>", "<SCRIPT>", "</Style>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    live = re.compile(r"(<(script|style)(?![A-Za-z0-9-])[^>]*>).*?(</\2[^>]*>)|<!--.*?-->", re.I | re.S)
    spoken = re.compile(r"<(script|style|template)(?![A-Za-z0-9-])[^>]*>.*?</\1[^>]*>|<!--.*?-->", re.I | re.S)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", live_html(F.col("t")).alias("live"), spoken_html(F.col("t")).alias("spoken")).collect():
        assert r["live"] == live.sub(lambda m: (m[1] or "") + (m[3] or ""), r["t"]), r["t"]
        assert r["spoken"] == spoken.sub(" ", r["t"]), r["t"]


def test_headings_equal_the_plain_pattern(spark):
    rng = random.Random(6)
    bits = ["<h1>", "</h1>", "<h2 id='x'>", "</h2>", "<h3", ">", "</h3>", "a", "b ", "<h10>", "<p>", "</p>", "<H2>", "&amp;", "</h6>", "<h1 name=n>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(800)]
    plain = re.compile(r"<h([1-6])(?![A-Za-z0-9_])([^>]*)>(.*?)</h\1>", re.I | re.S)
    clear = lambda x: re.sub(r"<[^>]+>", " ", x).replace("&amp;", "&").strip()
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, kept_html string")
    got = {}
    for r in page_sections(df).collect():
        got.setdefault(r["page_id"], []).append((r["section_no"], r["level"], r["heading"]))
    for k, t in enumerate(texts):
        found = [(int(m[1]), " ".join(clear(m[3]).split())) for m in plain.finditer(t)]
        kept = [f for f in found if f[1]]
        assert sorted(got.get(k, [])) == [(i + 1, *f) for i, f in enumerate(kept)], t
