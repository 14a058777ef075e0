"""Site-level operators: per-page outline (O45), breadth-first walk of a
stored snapshot (O47), one nested map per site (O48) and page lookups (O49).

The walk runs level by level: a level is a set (FIFO order is kept by a
rank), joined to the snapshot and to the link table by key, new paths are
kept with a left-anti join against the seen set, and each level's state is
cut from the lineage with ``checkpoint()`` into the session's checkpoint
folder. The number of levels is bounded by the page budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.links import url_parts
from tessera.session import checkpoint_dir, materialize


def site_outline(page_facts: DataFrame, links: DataFrame) -> DataFrame:
    """Per page title, auth flag and counts of page links, anchors,
    forms and API hints. ``page_facts`` (page_id, title, auth_required,
    n_forms, n_api_hints) comes from one projection over the pages; only the
    link kinds are aggregated and joined on page_id."""
    lk = links.groupBy("page_id").agg(
        F.count_if(F.col("kind") == "page").cast("int").alias("n_pages"),
        F.count_if(F.col("kind") == "anchor").cast("int").alias("n_anchors"))
    out = page_facts.join(lk, "page_id", "left")
    return out.select("page_id", "title", "auth_required",
                      F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
                      F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"),
                      F.col("n_forms").cast("int").alias("n_forms"),
                      F.col("n_api_hints").cast("int").alias("n_api_hints"))


def crawl_snapshot(snapshot: DataFrame, edges: DataFrame, starts: DataFrame, max_pages: int = 10,
                   redirects: DataFrame | None = None) -> DataFrame:
    """FIFO breadth-first walk inside a stored snapshot, one walk per
    site, all sites at once.

    snapshot: (site, path, page_id) — the pages that exist; a queued path not
    in it is a failed attempt ('missing'). edges: (page_id, link_no,
    target_path) — same-origin links of each page. starts: (site, path).
    redirects: (site, path, final_site, final_path) — paths whose stored answer
    led elsewhere (see ``resolve_redirects``); a page is filed under, and its
    links come from, the final path.

    Returns one row per queued path: site, path, rank (queue order), level,
    outcome in {'mapped', 'missing', 'unvisited', 'off_origin' (the redirect left
    the site), 'duplicate' (its final path was mapped before)}, page_id when
    mapped, and final_site and final_path.
    The budget counts attempts including failures: queued paths beyond it are
    the leftover queue (outcome 'unvisited', rank null).
    """
    checkpoint_dir(starts.sparkSession)
    # Both are read once per level: save them once instead of re-deriving them.
    snap = materialize(snapshot.select("site", "path", "page_id"))
    ed = materialize(edges.select(F.col("page_id").alias("parent_id"), "link_no", "target_path"))
    frontier = materialize(starts.select("site", "path", F.lit(1).cast("long").alias("rank"), F.lit(0).alias("level")))
    queued = frontier
    level = 0
    if redirects is not None:
        redirects = materialize(redirects.select("site", "path", "final_site", "final_path"))

    def fetched(paths: DataFrame) -> DataFrame:
        """With where each path leads, and the page there if it is on the site."""
        if redirects is None:
            led = paths.withColumn("final_site", F.col("site")).withColumn("final_path", F.col("path"))
        else:
            led = paths.join(redirects, ["site", "path"], "left") \
                .withColumn("final_site", F.coalesce("final_site", "site")).withColumn("final_path", F.coalesce("final_path", "path"))
        there = snap.select(F.col("site").alias("final_site"), F.col("path").alias("final_path"), "page_id")
        return led.join(there, ["final_site", "final_path"], "left").withColumn("page_id", F.when(F.col("final_site") == F.col("site"), F.col("page_id")))

    earlier = None  # pages mapped on the levels before, kept only if paths can lead to one page twice
    while True:
        mapped = fetched(frontier.where(F.col("rank") <= max_pages)).where(F.col("page_id").isNotNull())
        if redirects is not None:
            mapped = mapped.groupBy("site", "page_id").agg(F.min("rank").alias("rank"))
            if earlier is not None:
                mapped = mapped.join(earlier.select("page_id"), "page_id", "left_anti")
            mapped = materialize(mapped)
            earlier = mapped if earlier is None else earlier.unionByName(mapped)
        new = (mapped.select("site", F.col("rank").alias("parent_rank"), F.col("page_id").alias("parent_id"))
               .join(ed, "parent_id")
               .select("site", F.col("target_path").alias("path"), "parent_rank", "link_no"))
        new = new.join(queued.select("site", "path"), ["site", "path"], "left_anti")
        first = new.groupBy("site", "path").agg(F.min(F.struct("parent_rank", "link_no")).alias("o"))
        top = queued.groupBy("site").agg(F.max("rank").alias("top"))
        level += 1
        # Only ranks within the budget are ever fetched: rank at most max_pages
        # new paths per site. The constant bound lets Spark keep a per-site
        # top-k on the map side, so a site with a huge link fan-out does not
        # send all its paths to one task; the rest stay unranked (leftovers).
        w = Window.partitionBy("site").orderBy(F.col("o.parent_rank"), F.col("o.link_no"))
        ranked = first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_pages)
        ranked = (ranked.join(top, "site").where(F.col("top") + F.col("rn") <= max_pages)
                  .select("site", "path", (F.col("top") + F.col("rn")).alias("rank")))
        nxt = (first.join(ranked, ["site", "path"], "left")
               .select("site", "path", "rank", F.lit(level).alias("level")))
        # Each level is saved once; the queue is the union of the saved levels.
        nxt = materialize(nxt)
        queued = queued.unionByName(nxt)
        frontier = nxt.where(F.col("rank").isNotNull())
        if level >= max_pages or frontier.isEmpty():
            break
    out = fetched(queued)
    visited = F.col("rank").isNotNull() & (F.col("rank") <= max_pages)
    first = F.lit(True)
    if redirects is not None:
        out = out.withColumn("first_rank", F.min(F.when(visited, F.col("rank"))).over(Window.partitionBy("site", "final_site", "final_path")))
        first = F.col("rank") == F.col("first_rank")
    outcome = (F.when(~visited, F.lit("unvisited")).when(F.col("final_site") != F.col("site"), F.lit("off_origin"))
               .when(F.col("page_id").isNull(), F.lit("missing")).when(first, F.lit("mapped")).otherwise(F.lit("duplicate")))
    return out.select("site", "path", "rank", "level", outcome.alias("outcome"),
                      F.when(outcome == "mapped", F.col("page_id")).alias("page_id"), "final_site", "final_path")


def site_awareness(walk: DataFrame, page_facts: DataFrame, max_pages: int = 10) -> DataFrame:
    """One nested row per site from a walk and per-page facts
    (page_id, title, summary, forms array, api_hints array, auth_required, and
    if there are such columns actions array and content)."""
    # most rows have no page; in the join they would all be one key
    w = walk.where("page_id is not null").join(page_facts, "page_id", "left").unionByName(walk.where("page_id is null"), allowMissingColumns=True)
    for name, kind in (("actions", "array<struct<type:string,label:string,leads_to:string,endpoint:string>>"), ("content", "string")):
        if name not in w.columns:
            w = w.withColumn(name, F.lit(None).cast(kind))
    mapped = F.col("outcome") == "mapped"
    g = w.groupBy("site").agg(
        F.max(F.when(F.col("rank") == 1, F.concat(F.col("site"), F.col("path")))).alias("url"),
        F.count_if(mapped).cast("int").alias("pages_scanned"),
        F.count_if(F.col("outcome") != "unvisited").cast("int").alias("pages_attempted"),
        F.count_if(F.col("outcome") == "missing").cast("int").alias("pages_failed"),
        F.count_if(F.col("outcome") == "unvisited").cast("int").alias("links_queued_unvisited"),
        F.transform(F.array_sort(F.collect_list(F.when(mapped, F.struct("rank", "final_path", "title", "summary", "content")))),
                    lambda x: F.struct(x["final_path"].alias("path"), x["title"].alias("title"),
                                       x["summary"].alias("summary"), x["content"].alias("content"))).alias("pages"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "missing", F.struct("rank", "path")))),
                    lambda x: F.struct(F.concat(F.col("site"), x["path"]).alias("url"),
                                       F.lit("not in the snapshot").alias("error"))).alias("failures"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "off_origin", F.struct("rank", "path", "final_site", "final_path")))),
                    lambda x: F.concat(F.col("site"), x["path"], F.lit(" -> "), x["final_site"], x["final_path"])).alias("off_origin_redirects_skipped"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(mapped, F.struct("rank", "forms")))),
                              lambda x: x["forms"])).alias("forms"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(mapped & F.col("actions").isNotNull(), F.struct("rank", "actions")))),
                              lambda x: x["actions"])).alias("actions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(mapped, F.col("api_hints")))))).alias("api_hints"),
        F.coalesce(F.bool_or(F.when(mapped, F.col("auth_required"))), F.lit(False)).alias("auth_required"))
    return g.withColumn("budget_exhausted",
                        (F.col("pages_attempted") >= max_pages) & (F.col("links_queued_unvisited") > 0))


def get_page(site_pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Exact (site, path) lookup; title and summary are null on a miss."""
    return requests.join(site_pages.select("site", "path", "title", "summary"), ["site", "path"], "left")


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    p = url_parts(F.col(url_col))
    site = F.concat(p["scheme"], F.lit("://"), p["host"],
                    F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")))
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    return df.withColumn("site", site).withColumn("path", path)
