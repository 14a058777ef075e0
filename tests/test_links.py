
from tessera.operators.links import classify_destination, extract_links, resolve_redirects, split_anchors


def test_contents_page_anchors_and_pages(spark, pages_df):
    html = ("<a href='#one'>1</a><a href=\"#two\">2</a><a href='/guide/next'>n</a><a href='?page=3'>q</a>"
            "<a href='mailto:a@b'>m</a><a href='javascript:void(0)'>j</a><a href='#one'>dup</a>"
            "<link href='https://other.example/x'><a href='../up/./x/../y?a=b c#f g'>r</a><a href='//ex.com:443/abs'>s</a>")
    df = pages_df([("https://Ex.com:443/docs/guide?p=1", html)])
    rows = split_anchors(extract_links(df)).orderBy("link_no").collect()
    assert [(r.kind, r.value) for r in rows] == [
        ("anchor", "#one"), ("anchor", "#two"),
        ("page", "https://ex.com/guide/next"), ("page", "https://ex.com/docs/guide?page=3"),
        ("page", "https://ex.com/up/y?a=b%20c#f%20g"), ("page", "https://ex.com/abs")]
    df2 = pages_df([("https://ex.com/docs/guide", "<a href='#one'>1</a><a href='#'>e</a><a href='/für,'>u</a>")])
    rows = split_anchors(extract_links(df2)).orderBy("link_no").collect()
    assert [(r.kind, r.value) for r in rows] == [
        ("anchor", "#one"), ("page", "https://ex.com/docs/guide#"), ("page", "https://ex.com/f%C3%BCr,")]


def test_redirect_chain(spark):
    starts = spark.createDataFrame([(1, "https://a.example/1"), (2, "https://a.example/10"), (3, "https://a.example/20")],
                                   "start_id long, url string")
    hops = [(f"https://a.example/{i}", f"/{i + 1}") for i in range(1, 9)]
    hops += [("https://a.example/10", "https://b.example/x"), ("https://a.example/20", "/21")]
    h = spark.createDataFrame(hops, "url string, location string")
    got = {r.start_id: r for r in resolve_redirects(starts, h).collect()}
    assert got[1].status == "too_many" and got[1].final_url == "https://a.example/6" and got[1].n_hops == 5
    assert got[2].status == "off_origin" and got[2].final_url == "https://b.example/x"
    assert got[3].status == "ok" and got[3].final_url == "https://a.example/21" and got[3].n_hops == 1


def test_destinations(spark):
    urls = ["http://127.0.0.1/", "http://10.1.2.3:8080/", "https://169.254.169.254/latest", "http://[::1]/",
            "http://[::ffff:192.168.1.1]/", "file:///etc/passwd", "http://100.64.0.1/", "http://8.8.8.8/",
            "http://[fd00::1]/", "http://localhost:3000/"]
    df = spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")
    allow = spark.createDataFrame([("10.1.2.3:8080",)], "entry string")
    got = {r.url_id: (r.status, r.rule) for r in classify_destination(df, allow).collect()}
    assert got[0] == ("blocked_reserved", "127.0.0.0/8 (loopback)")
    assert got[1] == ("allowed", None)
    assert got[2][1].startswith("169.254.0.0/16")
    assert got[3] == ("blocked_reserved", "::/128, ::1/128 (unspecified/loopback)")
    assert got[4] == ("blocked_reserved", "192.168.0.0/16 (private)")
    assert got[5] == ("blocked_scheme", None)
    assert got[6] == ("blocked_reserved", "100.64.0.0/10 (carrier NAT)")
    assert got[7] == ("allowed", None)
    assert got[8] == ("blocked_reserved", "fc00::/7 (unique local)")
    assert got[9] == ("allowed", None)
