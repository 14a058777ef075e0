import random

from pyspark.sql import functions as F

from tessera.operators.html import clean_pages
from tessera.operators.pages import page_title
from walks import strip_spans

CHROME_NAMES = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside"}


def _is_chrome(tag, attrs):
    if tag in CHROME_NAMES:
        return True
    if tag in {"article", "main", "body", "html"}:
        return False
    return 'class="menu"' in attrs


def _random_doc(rng: random.Random) -> str:
    tags = ["nav", "div", "header", "p", "main", "h1", "footer", "span", "article", "aside"]
    out = []
    for _ in range(rng.randint(0, 14)):
        t = rng.choice(tags)
        r = rng.random()
        if r < 0.45:
            attrs = ' class="menu"' if rng.random() < 0.3 else ""
            out.append(f"<{t}{attrs}>")
        elif r < 0.85:
            out.append(f"</{t}>")
        elif r < 0.92:
            out.append(f"<{t}/>")
        else:
            out.append("<br>")
        out.append(rng.choice(["a", "b c", "", "x"]))
    return "".join(out)


def test_strip_matches_sequential_walk(spark, pages_df):
    rng = random.Random(7)
    docs = [_random_doc(rng) for _ in range(3000)]
    df = pages_df([("http://x/", d) for d in docs])
    got = {r.page_id: r for r in clean_pages(df).select("page_id", "kept_html", "cuts", "kept", "unclosed").collect()}
    bad = 0
    for i, d in enumerate(docs):
        html, cuts, kept, unclosed = strip_spans(d, _is_chrome)
        r = got[i]
        if (r.kept_html, r.cuts, r.kept, r.unclosed) != (html, cuts, kept, unclosed):
            bad += 1
            if bad < 3:
                print(d, (r.kept_html, r.cuts, r.kept, r.unclosed), (html, cuts, kept, unclosed))
    assert bad == 0


ARTICLE = ("<html><head><title>  Guide &amp; Notes </title><style>p{}</style></head><body>"
           "<header><h1>Main Title</h1><nav><a href='/a'>A</a></nav></header>"
           "<nav class='x'><nav>INNER</nav>OUTER</nav>"
           "<main><p>Caf&#233; &copy; 2026 &mdash; 5 &amp;lt; &#x41;&#0;&#x110000;&bogus;</p>"
           "<!-- <nav>hidden</nav> --><p>one</p><p>two</p></main>"
           "<div class='sidebar'>side</div><footer>foot</footer></body></html>")


def test_article_page(spark, pages_df):
    df = pages_df([("http://x/", ARTICLE)])
    r = clean_pages(df, extras={"title": page_title(F.col("html"))}).collect()[0]
    assert r.title == "Guide &amp; Notes"
    # header holds the h1: kept whole, and the nav inside it is not cut either
    assert "Main Title" in r.text and "A" in r.text.split()
    assert "INNER" not in r.text and "OUTER" not in r.text
    assert "Café © 2026 — 5 &lt; A&#0;&#x110000;&bogus;" in r.text
    assert "hidden" not in r.text and "side" not in r.text and "foot" not in r.text
    assert r.kept == 1 and r.unclosed is None


def test_unclosed_nav_stops_cutting(spark, pages_df):
    df = pages_df([("http://x/", "<p>a</p><nav>menu<p>b</p><footer>f</footer>")])
    r = clean_pages(df).collect()[0]
    assert r.unclosed == "nav" and r.cuts == 0 and "menu" in r.text and "f" in r.text


def test_whitespace_runs(spark, pages_df):
    df = pages_df([("http://x/", "<p>a</p><p>b</p>"), ("http://x/", "<h1>a</h1><p><b>b</b></p>")])
    t = {r.page_id: r.text for r in clean_pages(df).collect()}
    assert t[0] == "a  b"          # two spaces: no block break
    assert t[1] == "a\n\nb"        # three or more: one blank line


def test_null_and_empty_html(spark, pages_df):
    df = pages_df([("http://x/", None), ("http://x/", "")])
    rows = clean_pages(df, extras={"title": page_title(F.coalesce(F.col("html"), F.lit("")))}).collect()
    assert all(r.text == "" and r.title == "Untitled" for r in rows)


def test_long_attribute_no_stack_overflow(spark, pages_df):
    big = "x" * 200_000
    df = pages_df([("http://x/", f'<div title="{big}">ok</div><nav>n</nav>')])
    r = clean_pages(df).collect()[0]
    assert r.text == "ok" and r.cuts == 1
