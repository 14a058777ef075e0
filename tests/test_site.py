from collections import defaultdict

from pyspark.sql import functions as F

from samples import SF_SMALL
from tessera.operators.site import crawl_snapshot
from tessera.plans import site as PS
from walks import bfs


def _crawl(spark, pages, links, starts, budget):
    snap = spark.createDataFrame(pages, "site string, path string, page_id long")
    edges = spark.createDataFrame(links, "page_id long, link_no int, target_path string")
    st = spark.createDataFrame(starts, "site string, path string")
    return crawl_snapshot(snap, edges, st, max_pages=budget).collect()


def _summary(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.site].append(r)
    out = {}
    for site, rs in by.items():
        rs.sort(key=lambda r: (r.rank is None, r.rank or 0))
        out[site] = {"attempted": sum(r.outcome != "unvisited" for r in rs),
                     "mapped": [r.path for r in rs if r.outcome == "mapped"],
                     "failed": [r.path for r in rs if r.outcome == "missing"],
                     "left": sum(r.outcome == "unvisited" for r in rs)}
    return out


def test_budget_counts_failures(spark):
    links = [(1, i + 1, f"/dead/{i}") for i in range(500)]
    got = _summary(_crawl(spark, [("s", "/", 1)], links, [("s", "/")], 2))["s"]
    assert got == {"attempted": 2, "mapped": ["/"], "failed": ["/dead/0"], "left": 499}


def test_shared_dead_link_costs_once(spark):
    pages = [("s", f"/p{i}", i) for i in range(6)]
    links = [(0, i, f"/p{i}") for i in range(1, 6)] + [(0, 6, "/dead")] + [(i, 1, "/dead") for i in range(1, 6)]
    got = _summary(_crawl(spark, pages, links, [("s", "/p0")], 50))["s"]
    assert got["attempted"] == 7 and len(got["mapped"]) == 6 and got["failed"] == ["/dead"]


def test_walk_matches_fifo_queue(spark):
    """Whole crawl corpus of the small test tables against a FIFO walk."""
    rows = PS.q_crawl_walk(spark, SF_SMALL).collect()
    pages, walk = PS._walk(spark, SF_SMALL)
    from tessera.operators import links as L
    from tessera.operators.site import split_url
    norm = L.with_resolved_url(pages.select("page_id", "url"), "url", "url", "norm_url")
    snap = split_url(norm.select("page_id", F.col("norm_url").alias("url"))).groupBy("site", "path").agg(F.min("page_id").alias("page_id"))
    snap_rows = snap.collect()
    edges = split_url(L.extract_links(pages).select("page_id", "link_no", F.col("target_url").alias("url"))).collect()
    by_page = defaultdict(list)
    for e in sorted(edges, key=lambda e: (e.page_id, e.link_no)):
        by_page[e.page_id].append(e.path)
    site_pages = defaultdict(dict)
    first = {}
    for s in snap_rows:
        site_pages[s.site][s.path] = by_page.get(s.page_id, [])
        if s.site not in first or s.page_id < first[s.site][1]:
            first[s.site] = (s.path, s.page_id)
    # the linked sites' missing paths: one in three leads to /c/{4i}, one to another site
    leads = {f"/gone/{i}": f"/c/{4 * i}" if i % 3 == 0 else None for i in range(1, 200) if i % 3 < 2}
    want = {site: bfs(first[site][0], site_pages[site], PS.CRAWL_BUDGET, leads if ".links.example" in site else None) for site in site_pages}
    assert {r["outcome"] for r in rows} >= {"mapped", "missing", "unvisited", "off_origin"}
    assert _summary(rows) == want
