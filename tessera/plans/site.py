"""Registered site queries: snapshot crawl (O47), per-site maps (O48, O05),
redirect chains (O46) and destination policy (O51)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import spoken_html, tags_to_text
from tessera.operators import elements as E
from tessera.operators import html as H
from tessera.operators import links as L
from tessera.operators import pages as P
from tessera.operators import site as S
from tessera.plans.synth import synth_hosts, synth_link_hops, synth_links, synth_redirects, web_corpus
from tessera.session import materialize

CRAWL_BUDGET = 10


def _dealt(spark, pages):
    """Dealt by id into as many parts as the session's, so that each holds pages of every kind:
    a scan packs its files by their bytes, which say little of the work on a page."""
    return pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")


def crawl_corpus(spark, d):
    """Stored pages plus the nation pages and the linked customer sites."""
    return _dealt(spark, web_corpus(spark, d).unionByName(synth_links(spark, d)))


def _walk(spark, d, budget=CRAWL_BUDGET):
    pages = materialize(crawl_corpus(spark, d))
    norm = L.with_resolved_url(pages.select("page_id", "url"), "url", "url", "norm_url")
    snap = S.split_url(norm.select("page_id", F.col("norm_url").alias("url")))
    # one snapshot row per (site, path): the lowest page_id
    snap = snap.groupBy("site", "path").agg(F.min("page_id").alias("page_id"))
    links = L.extract_links(pages)
    edges = S.split_url(links.select("page_id", "link_no", F.col("target_url").alias("url"))) \
        .select("page_id", "link_no", F.col("path").alias("target_path"))
    starts = snap.groupBy("site").agg(F.min_by("path", "page_id").alias("path"))
    # stored redirects: where each one ends; one that ends nowhere stays a missing path
    hop_starts, hops = synth_link_hops(spark, d)
    ends = L.resolve_redirects(hop_starts, hops).where(F.col("status").isin("ok", "off_origin"))
    ends = S.split_url(ends.select(F.col("start_url").alias("url"), "final_url"))
    ends = S.split_url(ends.select("site", "path", F.col("final_url").alias("url")).withColumnsRenamed({"site": "s", "path": "p"}))
    redirects = ends.select(F.col("s").alias("site"), F.col("p").alias("path"), F.col("site").alias("final_site"), F.col("path").alias("final_path"))
    return pages, S.crawl_snapshot(snap, edges, starts, max_pages=budget, redirects=redirects)


def q_crawl_walk(spark, d):
    return _walk(spark, d)[1].select("site", "path", "rank", "level", "outcome", "page_id")


def _site_maps(spark, d):
    pages, walk = _walk(spark, d)
    walk = materialize(walk)
    # only the pages that the walk mapped are cleaned
    pages = materialize(_dealt(spark, pages.join(walk.where("outcome = 'mapped'").select("page_id"), "page_id", "left_semi")))
    # Each of the three is written before they meet. In one plan a small one becomes a broadcast that waits
    # for a core until the tasks of the others end, and past spark.sql.broadcastTimeout the query fails.
    clean = H.clean_pages(_dealt(spark, pages), extras={
        "title": P.page_title(F.col("html")), "api_hints": P.api_hints_quoted(F.col("html")),
        "auth_required": P.auth_required_substring(tags_to_text(spoken_html(F.col("html"))))})
    clean = materialize(clean.select("page_id", "title", P.page_summary(F.col("text")).alias("summary"), "api_hints", "auth_required",
                                     F.col("text").alias("content")))
    forms = materialize(E.extract_forms(_dealt(spark, pages)).groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("form_no", "page", "fields", "action", "method"))),
                    lambda x: F.struct(x["page"].alias("page"), x["fields"].alias("fields"),
                                       x["action"].alias("action"), x["method"].alias("method"))).alias("forms")))
    actions = materialize(E.extract_actions(_dealt(spark, pages)).groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("action_no", "type", "label", "leads_to", "endpoint"))),
                    lambda x: F.struct(x["type"].alias("type"), x["label"].alias("label"), x["leads_to"].alias("leads_to"),
                                       x["endpoint"].alias("endpoint"))).alias("actions")))
    facts = clean.join(forms, "page_id", "left").withColumn(
        "forms", F.coalesce("forms", F.array().cast("array<struct<page:string,fields:array<string>,action:string,method:string>>")))
    facts = facts.join(actions, "page_id", "left")
    return S.site_awareness(walk, facts, max_pages=CRAWL_BUDGET)


def q_site_awareness(spark, d):
    return _site_maps(spark, d)


def q_site_map_json(spark, d):
    m = _site_maps(spark, d)
    return m.select("site", F.to_json(F.struct(*[c for c in m.columns])).alias("json"))


def q_resolve_redirects(spark, d):
    starts, hops = synth_redirects(spark, d)
    return L.resolve_redirects(starts, hops)


def q_classify_destination(spark, d):
    urls, allow = synth_hosts(spark, d)
    return L.classify_destination(urls, allow)


QUERIES = {
    "crawl_walk": q_crawl_walk,
    "site_awareness": q_site_awareness,
    "site_map_json": q_site_map_json,
    "resolve_redirects": q_resolve_redirects,
    "classify_destination": q_classify_destination,
}
