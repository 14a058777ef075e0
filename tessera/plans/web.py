"""Registered web queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole pages table (plus the nation pages synthesised from
customer/nation, which carry forms, anchors and API paths the crawl lacks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import spoken_html, tags_to_text
from tessera.operators import elements as E
from tessera.operators import html as H
from tessera.operators import links as L
from tessera.operators import pages as P
from tessera.operators import site as S
from tessera.plans.synth import web_corpus
from tessera.session import materialize
from tessera.sources.pages import scan_pages

SEARCH_QUERY = "the"
TEXT_BUDGET = 1200


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return web_corpus(spark, d)


def _clean(spark: SparkSession, d: str, **extras) -> DataFrame:
    return H.clean_pages(_corpus(spark, d), extras=extras or None)


def q_scan_pages(spark, d):
    accepted, rejects = scan_pages(spark, f"{d}/pages.parquet")
    a = accepted.select("page_id", "site", "path", "n_bytes", F.lit(None).cast("string").alias("reason"))
    r = rejects.select("page_id", "site", "path", "n_bytes", "reason")
    return a.unionByName(r)


def q_html_tokens(spark, d):
    t = H.tokenize_html(_corpus(spark, d)).where("pos > 0")
    return t.groupBy("page_id").agg(
        F.count("*").cast("int").alias("n_tags"),
        F.count_if(F.col("closing")).cast("int").alias("n_closing"),
        F.count_if(F.col("self_closing") & ~F.col("closing")).cast("int").alias("n_self_closing"),
        F.count_distinct("tag").cast("int").alias("n_tag_names"))


def q_chrome_tags(spark, d):
    t = H.classify_chrome(H.tokenize_html(_corpus(spark, d))).where("is_chrome")
    return t.groupBy("page_id", "tag").agg(F.count("*").cast("int").alias("n"))


def q_chrome_strip(spark, d):
    return _clean(spark, d).select("page_id", "cuts", "kept", "unclosed")


def q_page_text(spark, d):
    return _clean(spark, d).select("page_id", "text")


def q_page_title(spark, d):
    return _corpus(spark, d).select("page_id", P.page_title(F.col("html")).alias("title"))


def q_page_summary(spark, d):
    return _clean(spark, d).select("page_id", P.page_summary(F.col("text")).alias("summary"))


def q_page_summary_300(spark, d):
    """The library's variant: 300 characters, trimmed."""
    return _clean(spark, d).select("page_id", P.page_summary(F.col("text"), n=300, trim=True).alias("summary"))


def _sections(spark, d):
    return P.page_sections(_clean(spark, d))


def q_page_sections(spark, d):
    return _sections(spark, d)


def q_page_outline(spark, d):
    return P.page_outline(_corpus(spark, d).select("page_id"), _sections(spark, d))


def q_fetch_section(spark, d):
    c = _corpus(spark, d)
    title = P.page_title(F.col("html"))
    first_word = F.lower(F.regexp_extract(title, r"^\s*(\S+)", 1))
    req = (c.select("page_id", first_word.alias("want"))
           .unionByName(c.select("page_id", F.lit("#top").alias("want")))
           .unionByName(c.select("page_id", F.lit("no such section").alias("want"))))
    return P.fetch_section(_sections(spark, d), req)


def _links(spark, d):
    return L.extract_links(_corpus(spark, d))


def q_page_links(spark, d):
    return _links(spark, d).select("page_id", "link_no", "target_url")


def q_link_kinds(spark, d):
    return L.split_anchors(_links(spark, d)).select("page_id", "link_no", "kind", "value")


def q_page_forms(spark, d):
    return E.extract_forms(_corpus(spark, d)).select("page_id", "form_no", "page", "fields", "method", "action")


def q_page_actions(spark, d):
    return E.extract_actions(_corpus(spark, d))


def q_api_hints_quoted(spark, d):
    return _corpus(spark, d).select("page_id", P.api_hints_quoted(F.col("html")).alias("api_hints"))


def q_api_hints_script(spark, d):
    return _corpus(spark, d).select("page_id", P.api_hints_script(F.col("html")).alias("api_hints"))


def q_auth_word(spark, d):
    return _corpus(spark, d).select("page_id", P.auth_required_word(tags_to_text(F.col("html"))).alias("auth_required"))


def q_auth_substring(spark, d):
    return _corpus(spark, d).select(
        "page_id", P.auth_required_substring(tags_to_text(spoken_html(F.col("html")))).alias("auth_required"))


def q_page_search(spark, d):
    return P.search_pages(H.clean_pages(web_corpus(spark, d, spread=True)), SEARCH_QUERY, ctx=1)


def q_text_budget(spark, d):
    c = _clean(spark, d, title=P.page_title(F.col("html")), url=F.col("url"))
    note = F.when(F.col("unclosed").isNotNull(), F.concat(
        F.lit("NOTE: <"), F.col("unclosed"), F.lit("> has no end tag, so its text is kept below.\n"))
    ).otherwise(F.lit(""))
    header = F.concat(F.lit("URL: "), F.col("url"), F.lit("\nTITLE: "), F.col("title"), F.lit("\n"), note, F.lit("\n"))
    out = P.budget_text(header, F.col("text"), TEXT_BUDGET)
    return c.select("page_id", out.alias("body"), F.length(out).cast("int").alias("n_chars"))


def q_site_outline(spark, d):
    c = _corpus(spark, d)
    html = F.coalesce(F.col("html"), F.lit(""))
    facts = c.select("page_id", P.page_title(html).alias("title"),
                     P.auth_required_word(tags_to_text(html)).alias("auth_required"),
                     F.size(E.forms_array(html)).alias("n_forms"),
                     F.size(P.api_hints_quoted(html)).alias("n_api_hints"))
    return S.site_outline(facts, L.split_anchors(L.extract_links(c)))


def q_get_page(spark, d):
    c = S.split_url(_corpus(spark, d))
    facts = H.clean_pages(c, extras={"title": P.page_title(F.col("html"))})
    facts = facts.select("page_id", "title", P.page_summary(F.col("text")).alias("summary"))
    site_pages = c.select("page_id", "site", "path").join(facts, "page_id")
    req = c.select("site", "path").unionByName(c.select("site", F.lit("/no/such/page").alias("path"))).distinct()
    # A snapshot may hold the same (site, path) twice: the lowest page_id wins.
    one = (site_pages.groupBy("site", "path")
           .agg(F.min_by(F.struct("title", "summary"), "page_id").alias("x"))
           .select("site", "path", "x.title", "x.summary"))
    return S.get_page(one, req)


def q_actions_for_path(spark, d):
    c = web_corpus(spark, d, spread=True)
    # read twice (the paths come from them): written once
    acts = materialize(E.extract_actions(c))
    # Requested paths: every button target found in the corpus.
    paths = (acts.where(F.col("type") == "button").select(F.col("leads_to").alias("path"))
             .where("path is not null").distinct())
    return E.actions_for_path(acts, paths).select("path", "page_id", "action_no", "type", "label", "leads_to")


QUERIES = {
    "scan_pages": q_scan_pages,
    "html_tokens": q_html_tokens,
    "chrome_tags": q_chrome_tags,
    "chrome_strip": q_chrome_strip,
    "page_text": q_page_text,
    "page_title": q_page_title,
    "page_summary": q_page_summary,
    "page_summary_300": q_page_summary_300,
    "page_sections": q_page_sections,
    "page_outline": q_page_outline,
    "fetch_section": q_fetch_section,
    "page_links": q_page_links,
    "link_kinds": q_link_kinds,
    "page_forms": q_page_forms,
    "page_actions": q_page_actions,
    "api_hints_quoted": q_api_hints_quoted,
    "api_hints_script": q_api_hints_script,
    "auth_word": q_auth_word,
    "auth_substring": q_auth_substring,
    "page_search": q_page_search,
    "text_budget": q_text_budget,
    "site_outline": q_site_outline,
    "get_page": q_get_page,
    "actions_for_path": q_actions_for_path,
}
